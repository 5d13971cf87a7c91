"""Readers: parquet tables, the article binding, text/CSV files, JSON replies, pages."""
