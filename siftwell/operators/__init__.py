"""Relational operators on documents, chunks, vectors and queries."""
