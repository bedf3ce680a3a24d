"""Relational operators: matching join, searches, reports, batch, index, sinks."""
