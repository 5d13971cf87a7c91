"""sharecast — article popularity analytics on Spark DataFrames.

Layout:
  sources/    readers of the input tables, text/CSV/parquet files, JSON replies, pages
  functions/  column-expression builders (labels, losses, hashing, page text)
  operators/  relational operators: split, features, dictionary, joins, ranks,
              gradient-descent trainers, scoring, evaluation, exploration
  plans/      end-to-end plans built from the operators, the query registry
              and the DuckDB oracle SQL
"""

__all__ = ["session", "schema"]
