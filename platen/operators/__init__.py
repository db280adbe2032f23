"""Operators over tables of documents, conversion chains, runs and evidence."""
