"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words: ``budget_pct`` percent of all words shared by
weight, no source above ``max_copies`` times its words, the excess shared again by
weight until none is above (solved at once as a water level over the sources in
order of cap per weight). Inside a source a document's expected copies are

    e = r * (1 + a * (g - gbar)),   r = target / source words,

where ``g`` in [0, 1) rises with its length, ``gbar`` is the word-weighted mean of
``g`` and ``a`` is the largest tilt up to ``TILT`` that keeps 0 <= e <= max_copies, so
the expected words are exactly the target. A document first gets its floor(e) certain
copies; the fraction ``p`` left is its inclusion probability for one more. Documents
are ranked by Pareto's key, random odds over inclusion odds, and taken in that order
while that brings the words nearer to what the source still needs: the sample size is
fixed in words, and a source misses its target by half a document at most.

The cut of each source is found without sorting the source in one task: words are
summed per (source, bin of the key) with map-side combining, the bin that holds the
cut is found by running sums over at most ``BINS`` bins, and only its documents are
ordered. What follows is a comparison per document with its source's cut.

The random number of a document is a hash of the seed, its id and its text, so reruns
agree. Integer sums (lengths in thousandths) keep targets and cuts independent of
the order of addition.

Defined cases: a null or empty text has size 0 and gets copies of nothing; a null
source is a source of its own, last; a null id is an id; repeated rows (same id and
text) share one random number and are taken or left together up to the cut; an empty
table gives no rows; input columns other than the id, the text, the source and
``keep`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import freeze_order, global_rank, rank_and_accumulate
from ..sources.files import pin_table
from .common import WS_CLASS, broadcast_if_small, pick

WEIGHTS = (3, 1, 2)
BUDGET_PCT = 150
MAX_COPIES = 2
SEED = 20
TILT = 0.5
HALF_WORDS = 100       # the document size at which g is one half
BINS = 16384


def text_words(c: Column) -> Column:
    """Number of words, without keeping them: their runs collapse to one mark each."""
    marks = F.regexp_replace(F.coalesce(c, F.lit("")), f"[^{WS_CLASS}]+", "x")
    return F.length(F.regexp_replace(marks, f"[{WS_CLASS}]+", "")).cast("long")


def length_score(size: Column) -> Column:
    """``g`` in thousandths: size / (size + HALF_WORDS), a whole number."""
    return F.floor(1000 * size / (size + F.lit(HALF_WORDS))).cast("long")


def uniform(seed: int, id_col: Column, text: Column) -> Column:
    """A number in (0, 1) from the seed, the id and the text (52 hash bits)."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit("")),
                               F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def source_targets(per_source: DataFrame, weights=WEIGHTS, budget_pct: int = BUDGET_PCT,
                   max_copies: int = MAX_COPIES) -> DataFrame:
    """``per_source`` (source, words, ...) with ``weight`` and ``target``; weights go
    round by code point of the source, null last. Sources are ranked and summed
    through range partitions, so their number may be large too."""
    ranked = global_rank(per_source, [F.col("source").asc_nulls_last()], rank_col="_rank", start=0)
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    ranked = (ranked.withColumn("weight", F.get(cycle, (F.col("_rank") % len(weights)).cast("int")).cast("long"))
              .withColumn("_cap", F.col("words") * max_copies).drop("_rank"))
    total = ranked.agg(F.sum("words").alias("w"), F.sum("weight").alias("k")).first()
    t, k = (total["w"] or 0) * budget_pct, total["k"] or 0          # t in hundredths of a word
    order = freeze_order(ranked, [], [(F.col("_cap") / F.col("weight")).asc(),
                                      F.col("source").asc_nulls_last()])
    run = rank_and_accumulate(order, [], sums=["_cap", "weight"])
    left_t = F.lit(t) - 100 * (F.col("cum__cap") - F.col("_cap"))
    left_k = F.lit(k) - (F.col("cum_weight") - F.col("weight"))
    run = run.withColumn("_full", 100 * F.col("_cap") * left_k <= F.col("weight") * left_t)
    full = run.filter("_full").agg(F.sum("_cap").alias("c"), F.sum("weight").alias("w")).first()
    rest_t, rest_k = t - 100 * (full["c"] or 0), k - (full["w"] or 0)
    share = (F.col("weight") * F.lit(rest_t)).cast("double") / F.lit(float(100 * max(rest_k, 1)))
    return run.select(*per_source.columns, "weight", F.when(F.col("_full"), F.col("_cap").cast("double"))
                      .otherwise(share).alias("target"))


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source", keep: tuple[str, ...] = (), weights=WEIGHTS,
                budget_pct: int = BUDGET_PCT, max_copies: int = MAX_COPIES,
                seed: int = SEED) -> DataFrame:
    """All documents with the copies the mix takes of them.

    Returns ``id_col``, ``source_col``, the columns of ``keep``, ``size``,
    ``source_size``, ``target`` (of the source), ``copies`` and ``taken`` (words)."""
    d = pick(docs, [id_col, text_col, source_col, *keep]).toDF("_id", "_text", "source", *keep)
    d = d.select("*", text_words(F.col("_text")).alias("_size"),
                 uniform(seed, F.col("_id"), F.col("_text")).alias("_u"))
    rows = pin_table(d.select("_id", "source", "_size", "_u"), "mix-sizes")
    sums = rows.groupBy("source").agg(
        F.sum("_size").alias("words"), F.sum(F.col("_size") * length_score(F.col("_size"))).alias("_gwords"))
    plan = source_targets(sums, weights, budget_pct, max_copies)
    rate = F.col("target") / F.col("words")
    mean = F.col("_gwords") / (1000.0 * F.col("words"))
    tilt = F.least(F.lit(TILT), F.greatest(F.lit(0.0), (F.lit(float(max_copies)) / rate - 1) / (1 - mean)))
    plan = plan.select("source", "words", "target", F.when(F.col("words") > 0, rate).alias("_rate"),
                       F.when((F.col("words") > 0) & (rate > 0), mean).alias("_mean"),
                       F.when((F.col("words") > 0) & (rate > 0), tilt).alias("_tilt"))
    plan = broadcast_if_small(pin_table(plan.withColumnRenamed("source", "_source"), "mix-plan"))

    def ranked(df: DataFrame) -> DataFrame:
        """With certain copies, and key and bin for one more (null: none)."""
        e = F.coalesce(F.col("_rate") * (1 + F.col("_tilt") * (
            length_score(F.col("_size")) / 1000.0 - F.col("_mean"))), F.lit(0.0))
        e = F.least(F.lit(float(max_copies)), F.greatest(F.lit(0.0), e))
        df = (df.join(plan, F.col("source").eqNullSafe(F.col("_source")), "left").withColumn("_e", e)
              .withColumn("_certain", F.floor("_e").cast("long"))
              .withColumn("_p", F.col("_e") - F.col("_certain")))
        odds = F.col("_u") / (1 - F.col("_u")) / (F.col("_p") / (1 - F.col("_p")))
        return (df.withColumn("_key", F.when((F.col("_p") > 0) & (F.col("_size") > 0), odds))
                .withColumn("_bin", F.floor(F.col("_key") / (1 + F.col("_key")) * BINS).cast("int")))

    r = ranked(rows)
    need = r.groupBy("_source").agg(
        (F.first("target") - F.sum(F.col("_certain") * F.col("_size"))).alias("_need"))
    bins = r.filter("_key is not null").groupBy("_source", "_bin").agg(F.sum("_size").alias("_bwords"))
    along = Window.partitionBy("_source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("_cum", F.sum("_bwords").over(along))
    need = need.withColumnRenamed("_source", "_nsource")
    cut = (bins.join(need, F.col("_source").eqNullSafe(F.col("_nsource")))
           .filter(F.col("_cum") > F.col("_need")).groupBy("_source")
           .agg(F.min_by(F.struct("_bin", (F.col("_cum") - F.col("_bwords")).alias("before"),
                                  "_need"), "_bin").alias("_cut")))
    cut = broadcast_if_small(pin_table(cut.select(
        F.col("_source").alias("_csource"), F.col("_cut._bin").alias("_cbin"),
        F.col("_cut.before").alias("_before"), F.col("_cut._need").alias("_need")), "mix-cut-bins"))
    in_bin = r.join(cut, F.col("_source").eqNullSafe(F.col("_csource")) & (F.col("_bin") == F.col("_cbin")))
    seq = (Window.partitionBy("_csource").orderBy("_key", F.col("_id").asc_nulls_first(), "_u")
           .rowsBetween(Window.unboundedPreceding, 0))
    edge = (in_bin.withColumn("_at", F.col("_before") + F.sum("_size").over(seq) - F.col("_size"))
            .filter(F.col("_at") + F.col("_size") / 2 <= F.col("_need"))
            .groupBy("_csource").agg(F.max(F.struct("_key", "_id")).alias("_last"))
            .withColumnRenamed("_csource", "_esource"))
    cuts = (cut.join(edge, F.col("_csource").eqNullSafe(F.col("_esource")), "left")
            .select(F.col("_csource").alias("_ksource"), F.col("_cbin").alias("_kbin"), "_last"))
    cuts = broadcast_if_small(pin_table(cuts, "mix-cuts"))
    full = ranked(d).join(cuts, F.col("source").eqNullSafe(F.col("_ksource")), "left")
    more = F.col("_key").isNotNull() & (F.col("_kbin").isNull() | (F.col("_bin") < F.col("_kbin")) | (
        (F.col("_bin") == F.col("_kbin")) & F.coalesce(
            F.struct("_key", "_id") <= F.col("_last"), F.lit(False))))
    copies = F.col("_certain") + more.cast("long")
    return full.select(
        F.col("_id").alias(id_col), F.col("source").alias(source_col), *keep,
        F.col("_size").alias("size"), F.col("words").alias("source_size"), "target",
        copies.alias("copies"), (copies * F.col("_size")).alias("taken"))
