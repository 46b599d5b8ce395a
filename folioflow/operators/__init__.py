"""Operators on notes: DataFrames with ``doc_id`` and ``text``."""
