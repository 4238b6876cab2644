"""Operators of a training-data pipeline on the tables documents, labels, benchmark and embeddings."""
