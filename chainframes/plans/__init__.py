"""Declarative descriptions of what to index, and the table query layer."""
