"""Tables: readers, writers and the views that the query catalogue runs on."""
