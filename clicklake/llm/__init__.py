"""Operators on text corpora and retrieved candidates; nothing else in the library imports this."""
