"""Tessera: a PySpark-native engine for document libraries and text corpora."""
