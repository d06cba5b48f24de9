"""Operators for building training corpora: filters, duplicates, leaks, tokens and binary output."""
