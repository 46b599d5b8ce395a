"""Spark-native structuring of Markdown notes, and operators for large text corpora in ``folioflow.llm``."""
