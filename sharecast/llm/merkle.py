"""Merkle manifest of a dataset: a tree of SHA-256 digests per group of rows, with the
proof of every row, by lag and lead windows.

Leaves are ranked inside their group by range partitions and chunk offsets, and cut into
aligned blocks of ``fan_out ** LEVELS`` leaves, so a window never holds more than a block
however large the group is. Inside a block one sort serves all levels: a node lives on the
row of its first leaf, level l finds the other slots of a run of nodes at the fixed
offsets fan_out ** l, 2 * fan_out ** l, ... before and behind it, masked by the node's
slot and by the run's length; the run's first child hashes the parent; and the last
node at or before a row hands its siblings to all its leaves. The nodes left per block
are the leaves of the next round, with the levels above them, until each group has one;
the groups' roots form one more tree. A round works on 4,096 times fewer rows than the
one before (block roots are written, the paths of leaves are not: they are computed
where they are used).

A proof holds, per level, the digests left and right of the path. Rehashing a (tampered)
leaf through its proof must give the root.

Defined cases: a null value is ``-`` in a leaf, so it differs from an empty one; a null
group is a group, ordered first; null ids come first in their group; equal ids are
ordered by leaf, equal leaves are interchangeable; a lone leaf is its group's root and
has an empty proof there; an empty table gives no rows; columns that are not hashed are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import global_rank
from ..sources.files import pin_table
from .common import broadcast_if_small, pick, sha256_hex

FAN_OUT = 2
LEVELS = 12                 # levels of a round: windows hold FAN_OUT ** LEVELS rows at most


def encoded(c: Column) -> Column:
    """A value without ambiguity: ``-`` for null, else its UTF-8 length, ``:``, itself."""
    text = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*columns: Column) -> Column:
    return sha256_hex(F.concat(*[encoded(c) for c in columns]))


def levels_below(size: Column, fan_out: int) -> Column:
    """Levels from ``size`` nodes down to one: the least l with fan_out ** l >= size."""
    powers = [fan_out ** i for i in range(64) if fan_out ** i < 1 << 62]
    return F.size(F.filter(F.array(*[F.lit(p) for p in powers]), lambda p: p < size))


def _block_paths(nodes: DataFrame, fan_out: int, levels: int) -> DataFrame:
    """``nodes`` (g, pos, size, up, node; pos from 0 inside g, which has size nodes and so
    many levels up to its root) with ``path``, the (left, right) siblings of up to
    ``levels`` levels, and ``top``, the digest of the last of these levels on the row of
    its first leaf. One exchange, one sort."""
    w = Window.partitionBy("g", "_block").orderBy("pos")
    filled = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = nodes.withColumn("_block", F.floor(F.col("pos") / fan_out ** levels).cast("long")).withColumn("_n0", F.col("node"))
    names = nodes.columns
    for level in range(levels + 1):
        step = fan_out ** level
        here = [*names, "_block", f"_n{level}", *[f"_p{i}" for i in range(level - 1)]]
        found = []
        if level:           # what the level below found reaches all its leaves
            found.append(F.last(f"_s{level - 1}", ignorenulls=True).over(filled).alias(f"_p{level - 1}"))
        if level < levels:
            found += [F.lag(f"_n{level}", k * step).over(w).alias(f"_l{k}") for k in range(1, fan_out)]
            found += [F.lead(f"_n{level}", k * step).over(w).alias(f"_r{k}") for k in range(1, fan_out)]
        rows = rows.select(*here, *found)
        if level < levels:
            # position of the node in its level, its slot in the run, and the run's length
            index = F.floor(F.col("pos") / step)
            slot = index % fan_out
            run = F.least(F.lit(fan_out), F.ceil(F.col("size") / step) - (index - slot))
            node = (F.col("pos") % step == 0) & (F.col("up") > level)
            left = F.concat(*[F.when(slot >= k, F.col(f"_l{k}")).otherwise("") for k in range(fan_out - 1, 0, -1)])
            right = F.concat(*[F.when(slot + k < run, F.col(f"_r{k}")).otherwise("") for k in range(1, fan_out)])
            parent = F.when(F.col("up") <= level, F.col(f"_n{level}")).when(
                F.col("pos") % (step * fan_out) == 0, F.sha2(F.concat(F.col(f"_n{level}"), right).cast("binary"), 256))
            rows = rows.select(*names, "_block", *[f"_p{i}" for i in range(level)], parent.alias(f"_n{level + 1}"),
                               F.when(node, F.struct(left.alias("left"), right.alias("right"))).alias(f"_s{level}"))
    path = F.filter(F.array(*[F.col(f"_p{i}") for i in range(levels)]), lambda s: s.isNotNull())
    return rows.select(*names, path.alias("path"), F.col(f"_n{levels}").alias("top"))


def tree_paths(nodes: DataFrame, *, fan_out: int = FAN_OUT, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """Per row of ``nodes`` (g, pos from 0 without gaps, node): the same, ``path`` (the
    (left, right) siblings from the row's level to the root) and ``root`` of its g; and
    the roots as a table (g, root)."""
    size = F.col("size")
    sizes = nodes.groupBy("g").agg(F.count(F.lit(1)).alias("size")).withColumn("up", levels_below(size, fan_out))
    now, rounds = nodes.join(broadcast_if_small(pin_table(sizes, "tree-sizes")), "g"), []
    while deep := now.agg(F.max("up")).first()[0] or 0:
        deep = min(deep, levels)
        rounds.append((now, deep))
        step = fan_out ** deep
        below = _block_paths(now.select("g", "pos", "size", "up", "node"), fan_out, deep)
        now = pin_table(below.filter(F.col("pos") % step == 0).select(
            "g", F.floor(F.col("pos") / step).cast("long").alias("pos"), F.ceil(size / step).cast("long").alias("size"),
            F.greatest(F.col("up") - deep, F.lit(0)).alias("up"), F.col("top").alias("node")), "tree-nodes")
    empty = F.array().cast("array<struct<left:string,right:string>>")
    roots = now.select("g", F.col("node").alias("root"))
    if not rounds:
        return now.select(*nodes.columns, F.col("node").alias("root"), empty.alias("path")), roots
    above = now.select("g", "pos", F.col("node").alias("root"), empty.alias("above"))
    for at, (now, deep) in reversed(list(enumerate(rounds))):
        up = broadcast_if_small(pin_table(above, "tree-above")).withColumnsRenamed({"g": "_g", "pos": "_at"})
        parent = F.floor(F.col("pos") / fan_out ** deep).cast("long")
        joined = _block_paths(now, fan_out, deep).join(up, (F.col("g") == F.col("_g")) & (parent == F.col("_at")))
        path = F.concat("path", "above")
        above = joined.select("g", "pos", "root", path.alias("above")) if at else joined.select(*nodes.columns, "root", path.alias("path"))
    return above, roots


def proof_digest(path: Column) -> Column:
    """SHA-256 of a proof's siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of a proof."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]).cast("binary"), 256))


def manifest(docs: DataFrame, columns: list[str], *, id_col: str = "doc_id", group_col: str = "lang",
             tampered: dict[str, Column] | None = None, fan_out: int = FAN_OUT, levels: int = LEVELS) -> DataFrame:
    """Per row: ``id_col``, ``group_col``, ``leaf`` (digest of ``columns``), ``subroot``,
    ``root``, ``path`` (its proof, through its group's tree and that of the groups) and
    ``seen_leaf``, the leaf after the changes of ``tampered`` ({column: new value})."""
    d = pick(docs, list(dict.fromkeys([id_col, group_col, *columns])))
    values = {c: F.col(c) for c in columns}
    leaf, seen = leaf_digest(*values.values()), leaf_digest(*(values | (tampered or {})).values())
    changed = F.lit(False)
    for c, v in (tampered or {}).items():
        changed = changed | ~v.eqNullSafe(values[c])
    # a string that orders null groups first, the others by their bytes
    group = F.when(F.col(group_col).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group_col).cast("string")))
    leaves = pin_table(d.select(F.col(id_col).alias("id"), group.alias("g"), leaf.alias("node"),
                                F.when(changed, seen).alias("seen")), "leaves")
    ranked = global_rank(leaves, [F.col("id").asc_nulls_first(), F.col("node").asc()], group_cols=["g"], rank_col="pos", start=0)
    paths, subroots = tree_paths(ranked.select("g", "pos", "node", "id", "seen"), fan_out=fan_out, levels=levels)
    order = pin_table(global_rank(subroots, [F.col("g").asc()], rank_col="pos", start=0).select(
        F.lit("").alias("g"), "pos", F.col("root").alias("node"), F.col("g").alias("group")), "subroot-order")
    upper = pin_table(tree_paths(order, fan_out=fan_out, levels=levels)[0].select(
        F.col("group").alias("_group"), F.col("root").alias("_root"), F.col("path").alias("_path")), "subroot-paths")
    return paths.join(broadcast_if_small(upper), F.col("g") == F.col("_group")).select(
        F.col("id").alias(id_col), F.when(F.col("g") != "", F.substring("g", 2, 1 << 30)).alias(group_col),
        F.col("node").alias("leaf"), F.coalesce("seen", "node").alias("seen_leaf"), F.col("root").alias("subroot"),
        F.col("_root").alias("root"), F.concat("path", "_path").alias("path"))


def verify(made: DataFrame) -> DataFrame:
    """The manifest with its proofs digested and the seen leaves folded through them."""
    folded = fold(F.col("seen_leaf"), F.col("path"))
    return (made.withColumn("proof_sha256", proof_digest(F.col("path"))).withColumn("folded_root", folded)
            .withColumn("verified", F.col("folded_root") == F.col("root")))
