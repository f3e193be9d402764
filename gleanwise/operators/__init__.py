"""DataFrame operators: observation analytics, result sets, documents, corpora, state."""
