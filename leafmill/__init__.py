"""Spark-native document analytics: lines, headings, tables, chunks and retrieval over whole corpora."""
