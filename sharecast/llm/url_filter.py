"""URL allow and block rules by hash-prefix lookup.

Every distinct (host, path) is expanded into expressions — each host suffix with
each path prefix that ends in a slash, and with the empty path — and joined to the
rules on a short prefix of the expression's SHA-256. Candidates are then confirmed
on the full digest and on the rule's whole path, and the longest rule wins.

A rule is indexed under its host and the part of its path up to the last slash, so
rules whose paths end elsewhere are found as well and confirmed by the path test.
Expressions deeper than the deepest rule cannot match and are not made. Distinct
(host, path) pairs are taken before the expansion, so a page that fills a third of
the table is expanded once. Rules are broadcast only if they measure small;
otherwise both sides are shuffled.

Defined cases: a url that is null or has no ``://`` has an empty host and path;
precedence is by length of host plus path, then of host, then block before allow;
repeated rules count once; rules with a null host or verdict are ignored, a null
path is empty; without rules every url gets the default; repeated pages each get
their row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_if_small, pick

PREFIX_HEX = 8
DEFAULT_VERDICT = "allow"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"

# The rules of the registered query (host, path, verdict).
QUERY_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def rules_table(spark: SparkSession, rules=QUERY_RULES) -> DataFrame:
    """Rules as a DataFrame of string columns host, path, verdict."""
    rows = [F.struct(*[F.lit(v).cast("string").alias(n) for n, v in
                       zip(("host", "path", "verdict"), r, strict=True)]) for r in rules]
    empty = "array<struct<host:string,path:string,verdict:string>>"
    return spark.range(1).select(F.inline(F.array(*rows).cast(empty)))


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*/)", 1)


def expressions(host: Column, path: Column, max_labels: int, max_slashes: int) -> Column:
    """Host suffixes of at most ``max_labels`` labels, each with the empty path and
    every slash-ended path prefix of at most ``max_slashes`` slashes."""
    labels, parts = F.split(host, r"\.", -1), F.split(path, "/", max_slashes + 1)
    suffixes = F.transform(
        F.sequence(F.greatest(F.lit(1), F.size(labels) - F.lit(max_labels - 1)), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda j: F.concat(
        F.array_join(F.slice(parts, F.lit(1), j), "/"), F.when(j > 0, F.lit("/")).otherwise(F.lit(""))))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def filter_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id",
                url_col: str = "url", default: str = DEFAULT_VERDICT,
                prefix_hex: int = PREFIX_HEX) -> DataFrame:
    """Returns ``id_col``, ``host``, ``path``, ``rule`` (host and path of the winning
    rule, null if none fits) and ``verdict``."""
    p = pick(pages, [id_col, url_col])
    p = p.toDF("_id", "_url").select("_id", host_of(F.col("_url")).alias("_host"),
                                     path_of(F.col("_url")).alias("_path"))
    r = (pick(rules, ["host", "path", "verdict"]).toDF("_rhost", "_rpath", "_verdict")
         .filter("_rhost is not null and _verdict is not null")
         .select(ascii_lower(F.col("_rhost")).alias("_rhost"),
                 F.coalesce("_rpath", F.lit("")).alias("_rpath"), "_verdict").distinct())
    r = r.withColumn("_stem", _stem(F.col("_rpath")))
    depth = r.agg(F.max(F.size(F.split("_rhost", r"\.", -1))),
                  F.max(F.size(F.split("_stem", "/", -1)) - 1)).first()
    digest = F.sha2(F.concat("_rhost", "_stem").cast("binary"), 256)
    r = r.select("_rhost", "_rpath", "_verdict", digest.alias("_rdigest"),
                 F.substring(digest, 1, prefix_hex).alias("_short"))
    urls = p.select("_host", "_path").distinct()
    asked = (urls.select("_host", "_path", F.explode(expressions(
                F.col("_host"), F.col("_path"), depth[0] or 1, depth[1] or 0)).alias("_expr"))
             .withColumn("_digest", F.sha2(F.col("_expr").cast("binary"), 256))
             .select("_host", "_path", "_digest", F.substring("_digest", 1, prefix_hex).alias("_short")))
    fits = (asked.join(broadcast_if_small(r), "_short")
            .filter((F.col("_digest") == F.col("_rdigest")) & F.startswith("_path", F.col("_rpath"))))
    best = fits.groupBy("_host", "_path").agg(F.max(F.struct(
        (F.length("_rhost") + F.length("_rpath")).alias("n"), F.length("_rhost").alias("h"),
        (F.col("_verdict") == "block").alias("b"), F.col("_verdict").alias("verdict"),
        F.concat("_rhost", "_rpath").alias("rule"))).alias("_best"))
    return p.join(best, ["_host", "_path"], "left").select(
        F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"),
        F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
