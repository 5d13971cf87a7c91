"""Column layout of the article table.

The analysed workload reads a 61-column comma+space separated file: position 0
is the url, position 1 the age in days (``timedelta``), positions 2..59 are the
58 predictors and position 60 the share count. Every predictor is a category:
its value stays a string, and the feature key is (position - 2, value).
"""

from __future__ import annotations

from pyspark.sql import types as T

# Header names of the article file, in file order.
ARTICLE_COLUMNS = [
    "url", "timedelta", "n_tokens_title", "n_tokens_content", "n_unique_tokens",
    "n_non_stop_words", "n_non_stop_unique_tokens", "num_hrefs", "num_self_hrefs",
    "num_imgs", "num_videos", "average_token_length", "num_keywords",
    "data_channel_is_lifestyle", "data_channel_is_entertainment", "data_channel_is_bus",
    "data_channel_is_socmed", "data_channel_is_tech", "data_channel_is_world",
    "kw_min_min", "kw_max_min", "kw_avg_min", "kw_min_max", "kw_max_max", "kw_avg_max",
    "kw_min_avg", "kw_max_avg", "kw_avg_avg", "self_reference_min_shares",
    "self_reference_max_shares", "self_reference_avg_sharess", "weekday_is_monday",
    "weekday_is_tuesday", "weekday_is_wednesday", "weekday_is_thursday",
    "weekday_is_friday", "weekday_is_saturday", "weekday_is_sunday", "is_weekend",
    "LDA_00", "LDA_01", "LDA_02", "LDA_03", "LDA_04", "global_subjectivity",
    "global_sentiment_polarity", "global_rate_positive_words",
    "global_rate_negative_words", "rate_positive_words", "rate_negative_words",
    "avg_positive_polarity", "min_positive_polarity", "max_positive_polarity",
    "avg_negative_polarity", "min_negative_polarity", "max_negative_polarity",
    "title_subjectivity", "title_sentiment_polarity", "abs_title_subjectivity",
    "abs_title_sentiment_polarity", "shares",
]

# Roles of the non-predictor positions and the popularity rule.
URL_POSITION = 0
AGE_POSITION = 1
FIRST_PREDICTOR_POSITION = 2
POPULARITY_THRESHOLD = 50.0
LINE_SEPARATOR = ", "


def predictor_names(columns: list[str] | None = None) -> list[str]:
    """Predictors are every column between the age column and the last column."""
    cols = columns or ARTICLE_COLUMNS
    return cols[FIRST_PREDICTOR_POSITION:-1]


def article_schema(columns: list[str] | None = None) -> T.StructType:
    """Explicit schema: url string, timedelta double, predictors string, shares double.

    Predictors stay strings on purpose: ``'0.0'`` and ``'0'`` are two categories.
    """
    cols = columns or ARTICLE_COLUMNS
    fields = [T.StructField(cols[0], T.StringType(), True),
              T.StructField(cols[1], T.DoubleType(), True)]
    fields += [T.StructField(c, T.StringType(), True) for c in predictor_names(cols)]
    fields.append(T.StructField(cols[-1], T.DoubleType(), True))
    return T.StructType(fields)


def header_line(columns: list[str] | None = None) -> str:
    return LINE_SEPARATOR.join(columns or ARTICLE_COLUMNS)
