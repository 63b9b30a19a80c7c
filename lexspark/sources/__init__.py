"""Reading and writing corpora, questions, indexes and submissions."""
