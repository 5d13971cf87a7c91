"""Column helpers shared by the corpus operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The six ASCII white-space characters the contracts name (space, tab, LF, VT, FF, CR).
WS = " \t\n\x0b\x0c\r"
WS_CLASS = r"\x20\x09-\x0D"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: A table is broadcast only when its measured size is at most this.
BROADCAST_BYTES = 8 << 20


def pick(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """The named columns of ``df`` and nothing else.

    Columns are found by position after an exact (then a case-insensitive) name
    match, so extra columns — also ones whose names differ from a wanted one in
    case only, or repeat it — neither clash nor get read."""
    have = df.columns
    out = []
    for name in names:
        at = [i for i, c in enumerate(have) if c == name] or [
            i for i, c in enumerate(have) if c.lower() == name.lower()]
        if not at:
            raise ValueError(f"column {name!r} is missing; there are {have}")
        out.append((at[0], name))
    plain = df.toDF(*[f"_c{i}" for i in range(len(have))])
    return plain.select(*[F.col(f"_c{i}").alias(name) for i, name in out])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row (bound as a lambda
    variable), however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, every other character kept (``lower`` would also change
    letters outside ASCII)."""
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """Maximal runs of non-white-space characters (ASCII white space only)."""
    return F.regexp_extract_all(c, F.lit(f"[^{WS_CLASS}]+"), F.lit(0))


def sha256_hex(c: Column) -> Column:
    """Lower-case hex SHA-256 of the UTF-8 bytes."""
    return F.sha2(c.cast("binary"), 256)


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its measured size is at most ``max_bytes``;
    else ``df`` itself, for a shuffle join that adaptive execution may split."""
    width = F.lit(16 * len(df.columns))
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`")))), F.lit(0))
    size = df.agg(F.sum(width.cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= max_bytes else df


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package's modules (once per application), wherever
    the driver was started: Spark distributes a zip of its source files."""
    sc = spark.sparkContext
    if getattr(sc, "_shipped_package", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="package-"), "modules.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._shipped_package = True
