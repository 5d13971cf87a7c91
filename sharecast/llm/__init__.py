"""Operators of a training-data pipeline: formatting, deduplication, filtering,
mixing, search and tokenization of large text corpora as Spark jobs."""
