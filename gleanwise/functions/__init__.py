"""Column functions: text, URLs, numbers and flags."""
