"""Linear models fitted by full-batch gradient descent on DataFrames.

The update follows the documented behaviour of MLlib's ``GradientDescent`` with
``SquaredL2Updater`` (the reference trainers): weights start at 0 and the
intercept — an extra always-on feature — at 1.0; at iteration t the step is
``step / sqrt(t)`` and ``w <- w * (1 - step_t * reg) - step_t * mean_gradient``
for every weight including the intercept; from the second iteration on the
loop stops when ``||w_t - w_{t-1}|| < tol * max(||w_t||, 1)``.

Data layout: the *design* table has one row per article with the sorted array
of its active feature ids, the intercept (``-1``) first. With at most
``broadcast_rows`` weights one iteration is

  scan of the design → margin = the row's weights added (the weight vector is a
  literal of the plan, shipped once per stage) → residual → explode → residual
  sums per feature (partial aggregate, one shuffle),

without a join, sort or window over the design. The summed gradient, as long as
the weight vector, comes back to the driver, which updates the weights (what a
broadcast of the weights would ship as well).

Larger models are cut into *cells*: feature ids into blocks of ``BLOCK_FEATURES``,
articles into slices. The design is written once, bucketed by cell, with one row
per (cell, article), and so is the list of every article's cells, bucketed by
article. Per iteration weights, one array per block, go to the block's cells; a row's
share of the margin is summed where it lies; these partial sums (two whole numbers
per cell and article) are shuffled to their articles; and residuals return to the
cells by a join that leaves the design in place. Weights are a written table per
iteration.

Weights in margins and residuals in gradients are summed as two whole numbers each
(units of 2^-26 and 2^-52), so margins and sums — and with them the weights, and the
order of scores — do not depend on the order of rows, partitionings or retries, and
are the same on either side of the bound.
"""

from __future__ import annotations

import json
import math
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import sigmoid, signed_label
from .joins import DEFAULT_BROADCAST_ROWS

BIAS_ID = -1
BLOCK_FEATURES = 1 << 16
_UNIT = float(1 << 26)


@dataclass(frozen=True)
class GDConfig:
    loss: str = "logistic"          # 'logistic' (logistic regression) | 'hinge' (linear SVM)
    iterations: int = 50
    step: float = 1.0
    reg: float = 1e-6
    tol: float = 1e-3
    initial_intercept: float = 1.0
    broadcast_rows: int = DEFAULT_BROADCAST_ROWS   # largest weight vector held in one piece


@dataclass
class LinearModel:
    name: str
    weights: DataFrame            # feature_id, n_rows, weight (intercept: feature_id -1)
    iterations_run: int
    vector: np.ndarray | None = field(default=None, repr=False)   # intercept first; None above the bound

    def coefficients(self) -> DataFrame:
        return self.weights.filter(F.col("feature_id") != F.lit(BIAS_ID))

    def intercept(self) -> DataFrame:
        return (self.weights.filter(F.col("feature_id") == F.lit(BIAS_ID))
                .select(F.col("weight").alias("intercept")))


# --- design ---------------------------------------------------------------------

def design_arrays(encoded: DataFrame, labeled: DataFrame, keep: list[str]) -> DataFrame:
    """One row per article of ``labeled``: ``keep`` and ``slots``, its active feature
    ids in ascending order after the intercept's."""
    bias = labeled.select(*keep, F.lit(BIAS_ID).cast("bigint").alias("feature_id"))
    rows = encoded.select(*keep, F.col("feature_id").cast("bigint")).unionByName(bias)
    return rows.groupBy(*keep).agg(F.sort_array(F.collect_list("feature_id")).alias("slots"))


def design_table(encoded: DataFrame, labeled: DataFrame, keep: list[str]) -> DataFrame:
    """:func:`design_arrays`, written once in the shared folder."""
    from ..sources.files import pin_table

    return pin_table(design_arrays(encoded, labeled, keep), "design")


def initial_weights(dictionary: DataFrame, n_articles: int,
                    intercept: float = 1.0) -> DataFrame:
    spark = dictionary.sparkSession
    feats = dictionary.select(F.col("feature_id").cast("bigint"), F.col("n_rows").cast("bigint"),
                              F.lit(0.0).alias("weight"))
    bias = spark.range(1).select(F.lit(BIAS_ID).cast("bigint").alias("feature_id"),
                                 F.lit(n_articles).cast("bigint").alias("n_rows"),
                                 F.lit(float(intercept)).alias("weight"))
    return feats.unionByName(bias)


def residual(margin, label, loss: str):
    """d(loss)/d(margin) of one row: sigmoid(m) - y, or the hinge sub-gradient."""
    if loss == "logistic":
        return sigmoid(margin) - label
    if loss == "hinge":
        s = signed_label(label)
        return F.when(F.lit(1.0) > s * margin, -s).otherwise(F.lit(0.0))
    raise ValueError(f"unknown loss {loss!r}")


def step_constants(cfg: GDConfig, t: int) -> tuple[float, float]:
    """(step_t, shrink_t) of iteration t (1-based)."""
    s = cfg.step / math.sqrt(t)
    return s, 1.0 - s * cfg.reg


def _whole(r: Column) -> tuple[Column, Column]:
    """A number of [-1, 1] as two whole numbers, in units of 2^-26 and 2^-52."""
    high = F.floor(r * F.lit(_UNIT))
    return high, F.floor((r * F.lit(_UNIT) - high) * F.lit(_UNIT))


def _sums(names: list[str]) -> list[Column]:
    return [F.sum(f"{n}_{part}").alias(f"{n}_{part}") for n in names for part in ("h", "l")]


def _total(name: str) -> Column:
    return (F.col(f"{name}_h").cast("double") + F.col(f"{name}_l").cast("double") / F.lit(_UNIT)) / F.lit(_UNIT)


def _with_whole(rows: DataFrame, residuals: dict[str, Column], *others) -> DataFrame:
    rows = rows.select(*others, *[r.alias(n) for n, r in residuals.items()])    # residuals once per row
    kept = [F.col(c) for c in rows.columns if c not in residuals]
    cols = []
    for n in residuals:
        high, low = _whole(F.col(n))
        cols += [high.cast("long").alias(f"{n}_h"), low.cast("long").alias(f"{n}_l")]
    return rows.select(*kept, *cols)


# --- models within the bound -----------------------------------------------------

def _literal(vector: np.ndarray) -> Column:
    """The vector as one constant of the plan (decimal texts of doubles read back exactly)."""
    return F.from_json(F.lit(json.dumps(vector.tolist())), "array<double>")


def whole_parts(vector: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weights as two whole numbers each, in units of 2^-26 and 2^-52 (as doubles,
    whose sums are exact up to 2^53)."""
    high = np.floor(vector * _UNIT)
    return high, np.floor((vector * _UNIT - high) * _UNIT)


def vector_margin(vector: np.ndarray, slots="slots") -> Column:
    """Weights of a row's slots added exactly; slots beyond the vector add nothing."""
    high, low = (_added(_literal(part), slots, lambda i: (i + 1).cast("int"), F.lit(0.0)) for part in whole_parts(vector))
    return (high + low / F.lit(_UNIT)) / F.lit(_UNIT)


def _added(weights: Column, slots, place, zero: Column) -> Column:
    """Sum of the weights (an array) at the places of a row's slots."""
    return F.aggregate(slots, zero, lambda acc, i: acc + F.coalesce(F.get(weights, place(i)), zero))


# Residuals in SQL; {m} is the margin.
_RESIDUALS = {
    "logistic": "1D / (1D + exp(-({m}))) - label",
    "hinge": "CASE WHEN 1D > (2D * label - 1D) * ({m}) THEN 1D - 2D * label ELSE 0D END",
}


#: Rows of at most so many slots, and weights of at most so many features, are added
#: slot by slot in compiled code; others in a lambda, which is interpreted.
UNROLLED_SLOTS, UNROLLED_WEIGHTS = 16, 4096


def most_slots(design: DataFrame) -> int:
    return design.agg(F.max(F.size("slots"))).first()[0] or 0


def _margin_part(argument: str, width: int | None) -> str:
    """SQL of the weights (a JSON argument) of a row's slots added; ``width`` is the
    largest number of slots, if they are to be added one by one."""
    weights = f"from_json(:{argument}, 'array<double>')"
    if width is None:
        return f"aggregate(slots, 0D, (acc, i) -> acc + coalesce(get({weights}, CAST(i + 1 AS INT)), 0D))"
    return "(" + " + ".join(["0D"] + [f"coalesce(get({weights}, CAST(get(slots, {k}) + 1 AS INT)), 0D)" for k in range(width)]) + ")"


def vector_gradients(design: DataFrame, vectors: dict[str, np.ndarray], losses: dict[str, str],
                     width: int | None = None) -> DataFrame:
    """feature_id and, for every name, the summed residuals (``name``) of the rows in
    which the feature is active. One SQL text per set of models: an iteration changes
    its arguments only, which keeps the driver's part of an iteration small. ``width`` is
    the design's largest number of slots (:func:`most_slots`), if known; the sums are
    exact, so it changes the time only."""
    if width is not None and (width > UNROLLED_SLOTS or max(map(len, vectors.values())) > UNROLLED_WEIGHTS):
        width = None
    unit = f"{_UNIT!r}D"
    margins, residuals, parts, totals = [], [], [], []
    for n in vectors:
        high, low = (_margin_part(f"{n}_{part}", width) for part in ("h", "l"))
        margin = f"({high} + {low} / {unit}) / {unit}"
        margins.append(f"{margin} AS {n}_m")
        residuals.append(f"{_RESIDUALS[losses[n]].format(m=f'{n}_m')} AS {n}")
        parts += [f"CAST(floor({n} * {unit}) AS BIGINT) AS {n}_h",
                  f"CAST(floor(({n} * {unit} - floor({n} * {unit})) * {unit}) AS BIGINT) AS {n}_l"]
        totals.append(f"(CAST(sum({n}_h) AS DOUBLE) + CAST(sum({n}_l) AS DOUBLE) / {unit}) / {unit} AS {n}")
    text = (f"SELECT feature_id, {', '.join(totals)} FROM (SELECT explode(slots) AS feature_id, {', '.join(parts)} "
            f"FROM (SELECT slots, {', '.join(residuals)} FROM (SELECT slots, label, {', '.join(margins)} "
            f"FROM {{design}}))) GROUP BY feature_id")
    args = {f"{n}_{part}": json.dumps(x.tolist()) for n, v in vectors.items()
            for part, x in zip(("h", "l"), whole_parts(v), strict=True)}
    return design.sparkSession.sql(text, args=args, design=design)


def _fit_vectors(design: DataFrame, size: int, n: int,
                 configs: list[tuple[str, GDConfig]]) -> list[tuple[np.ndarray, int]]:
    """Weight vectors of all models and their iterations; one scan of the design per
    iteration serves all models still running."""
    now, done, active = {}, {}, {}
    for i, (_, c) in enumerate(configs):
        now[i] = np.zeros(size + 1)
        now[i][0] = c.initial_intercept
        done[i], active[i] = 0, c.iterations > 0
    t, width = 0, most_slots(design) if any(active.values()) else 0
    while any(active.values()):
        t += 1
        live = [i for i in active if active[i]]
        got = vector_gradients(design, {f"g{i}": now[i] for i in live},
                               {f"g{i}": configs[i][1].loss for i in live}, width).toArrow()
        at = got.column("feature_id").to_numpy() + 1
        for i in live:
            c = configs[i][1]
            g = np.zeros(size + 1)
            g[at] = got.column(f"g{i}").to_numpy()
            s, shrink = step_constants(c, t)
            new = now[i] * shrink - s * (g / float(n))
            moved, norm = math.sqrt(((new - now[i]) ** 2).sum()), math.sqrt((new ** 2).sum())
            now[i], done[i] = new, t
            if t >= c.iterations or (t > 1 and moved < c.tol * max(norm, 1.0)):
                active[i] = False
    return [(now[i], done[i]) for i in range(len(configs))]


def vector_weights(dictionary: DataFrame, n: int, vector: np.ndarray) -> DataFrame:
    """feature_id, n_rows, weight of a weight vector."""
    base = initial_weights(dictionary, n)
    return base.withColumn("weight", F.get(_literal(vector), (F.col("feature_id") + 1).cast("int")))


# --- models above the bound ------------------------------------------------------

def _block(feature_id: Column) -> Column:
    return F.floor((feature_id + 1) / F.lit(BLOCK_FEATURES))


def cell_table(design: DataFrame, slices: int) -> DataFrame:
    """The design by cells (block, slice of articles), written bucketed by cell: one
    row per (cell, article) with the article's ids of that block."""
    from ..sources.files import write_bucketed

    part = F.pmod(F.xxhash64("article_id"), F.lit(slices))
    rows = (design.select("article_id", "label", F.explode("slots").alias("f"))
            .groupBy("article_id", "label", _block(F.col("f")).alias("block"))
            .agg(F.sort_array(F.collect_list("f")).alias("slots")))
    return write_bucketed(rows.withColumn("cell", F.col("block") * F.lit(slices) + part), "cells", "cell")


def article_cells(cells: DataFrame) -> DataFrame:
    """article_id and the cells it has rows in, written once, bucketed by article."""
    from ..sources.files import write_bucketed

    return write_bucketed(cells.groupBy("article_id").agg(F.collect_set("cell").alias("_cells")), "article_cells", "article_id")


def weight_blocks(weights: DataFrame) -> DataFrame:
    """block and the whole parts of its weights as arrays in feature order."""
    high, low = _whole(F.col("weight"))
    dense = F.sort_array(F.collect_list(F.struct(
        F.pmod(F.col("feature_id") + 1, F.lit(BLOCK_FEATURES)).cast("int").alias("i"),
        high.cast("long").alias("h"), low.cast("long").alias("l"))))
    # ids 0..n-1 have no gaps, so the sorted weights are the array
    return weights.groupBy(_block(F.col("feature_id")).alias("block")).agg(dense.alias("w")).select(
        "block", F.transform("w", lambda x: x["h"]).alias("wh"), F.transform("w", lambda x: x["l"]).alias("wl"))


def cell_margins(cells: DataFrame, weights: DataFrame, slices: int) -> DataFrame:
    """article_id, label, margin. A cell sends two whole numbers per article; their sums
    do not depend on the order of cells."""
    blocks = weight_blocks(weights).select("wh", "wl", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(slices - 1)), lambda s: F.col("block") * F.lit(slices) + s)).alias("cell"))
    shares = [_added(F.col(f"w{part}"), "slots", lambda i: F.pmod(i + 1, F.lit(BLOCK_FEATURES)).cast("int"),
                     F.lit(0).cast("long")).alias(f"m_{part}") for part in ("h", "l")]
    return (cells.join(blocks, "cell").select("article_id", "label", *shares)
            .groupBy("article_id").agg(F.max("label").alias("label"), *_sums(["m"]))
            .select("article_id", "label", _total("m").alias("margin")))


def cell_gradients(cells: DataFrame, weights: DataFrame, slices: int, loss: str,
                   homes: DataFrame | None = None) -> DataFrame:
    """feature_id, grad_sum; the rows of ``cells`` are read where they lie twice and
    never shuffled. ``homes`` is :func:`article_cells` of the cells."""
    margins = cell_margins(cells, weights, slices)
    homes = homes if homes is not None else article_cells(cells)
    back = _with_whole(margins.join(homes, "article_id"),
                       {"g": residual(F.col("margin"), F.col("label"), loss)},
                       "article_id", F.explode("_cells").alias("cell"))
    rows = cells.select("cell", F.col("article_id").alias("_a"), "slots").join(
        back.withColumnRenamed("cell", "_c"), (F.col("cell") == F.col("_c")) & (F.col("_a") == F.col("article_id")))
    g = (rows.select(F.explode("slots").alias("feature_id"), "g_h", "g_l")
         .groupBy("feature_id").agg(*_sums(["g"])))
    return g.select("feature_id", _total("g").alias("grad_sum"))


@contextmanager
def _joins_in_place(spark):
    """Joins on (cell, article) keep a table that is bucketed by cell alone in place."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _fit_cells(design: DataFrame, dictionary: DataFrame, n: int, cfg: GDConfig,
               name: str) -> tuple[DataFrame, int]:
    from pyspark.sql import Observation

    from ..sources.files import drop_files, pin_table

    spark = design.sparkSession
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    w, path = pin_table(initial_weights(dictionary, n, cfg.initial_intercept), f"{name}-w0", with_path=True)
    cells, done = cell_table(design, slices), 0
    homes = article_cells(cells)
    for t in range(1, cfg.iterations + 1):
        s, shrink = step_constants(cfg, t)
        g = cell_gradients(cells, w, slices, cfg.loss, homes)
        mean = F.coalesce(F.col("grad_sum"), F.lit(0.0)) / F.lit(float(n))
        new = w.join(g, "feature_id", "left").select(
            "feature_id", "n_rows", F.col("weight").alias("_old"),
            (F.col("weight") * F.lit(shrink) - F.lit(s) * mean).alias("weight"))
        obs = Observation(f"{name}-{t}")
        new = new.observe(obs, F.sum((F.col("weight") - F.col("_old")) ** 2).alias("moved"),
                          F.sum(F.col("weight") ** 2).alias("norm"))
        with _joins_in_place(spark):
            pinned, new_path = pin_table(new.drop("_old"), f"{name}-w{t}", with_path=True)
        drop_files(spark, path)            # superseded: nothing reads it any more
        w, path, done = pinned, new_path, t
        if t > 1 and math.sqrt(obs.get["moved"]) < cfg.tol * max(math.sqrt(obs.get["norm"]), 1.0):
            break
    return w, done


# --- fit and score ---------------------------------------------------------------

def gradient_step(design: DataFrame, dictionary: DataFrame, n: int, cfg: GDConfig) -> DataFrame:
    """The first iteration: feature_id, grad_sum and the weight after it, for every
    feature of the dictionary and the intercept."""
    weights = initial_weights(dictionary, n, cfg.initial_intercept)
    size = weights.count() - 1
    if size + 1 <= cfg.broadcast_rows:
        start = np.zeros(size + 1)
        start[0] = cfg.initial_intercept
        g = vector_gradients(design, {"grad_sum": start}, {"grad_sum": cfg.loss})
    else:
        slices = int(design.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        g = cell_gradients(cell_table(design, slices), weights, slices, cfg.loss)
    s, shrink = step_constants(cfg, 1)
    grad = F.coalesce(F.col("grad_sum"), F.lit(0.0))
    return weights.join(g, "feature_id", "left").select(
        "feature_id", grad.alias("grad_sum"),
        (F.col("weight") * F.lit(shrink) - F.lit(s) * (grad / F.lit(float(n)))).alias("weight"))


def fit(design: DataFrame, dictionary: DataFrame, n: int, cfg: GDConfig,
        name: str) -> LinearModel:
    """Run up to ``cfg.iterations`` steps with the convergence rule above. Every feature
    of the dictionary keeps a weight, whether or not a design row has it."""
    return fit_many(design, dictionary, n, [(name, cfg)])[0]


def fit_many(design: DataFrame, dictionary: DataFrame, n: int,
             configs: list[tuple[str, GDConfig]]) -> list[LinearModel]:
    """Fit several models on one design table. Within the bound they share each
    iteration's scan; a model that has stopped keeps its weights."""
    from ..sources.files import pin_table

    size = dictionary.count()
    out: list[LinearModel | None] = [None] * len(configs)
    small = [i for i, (_, c) in enumerate(configs) if size + 1 <= c.broadcast_rows]
    for i, (vector, done) in zip(small, _fit_vectors(design, size, n, [configs[i] for i in small]), strict=True):
        name = configs[i][0]
        out[i] = LinearModel(name, pin_table(vector_weights(dictionary, n, vector), f"{name}-weights"), done, vector)
    for i, (name, c) in enumerate(configs):
        if out[i] is None:
            w, done = _fit_cells(design, dictionary, n, c, name)
            out[i] = LinearModel(name, w, done)
    return out


def _vector_of(model: LinearModel, broadcast_rows: int) -> np.ndarray | None:
    """The model's weights as a vector, if they are few enough."""
    if model.vector is not None and len(model.vector) <= broadcast_rows:
        return model.vector
    if model.weights.limit(broadcast_rows + 1).count() > broadcast_rows:
        return None
    got = model.weights.select("feature_id", "weight").toArrow()
    at = got.column("feature_id").to_numpy() + 1
    vector = np.zeros(int(at.max(initial=0)) + 1)
    vector[at] = got.column("weight").to_numpy()
    return vector


def score_design(design: DataFrame, fitted: list[LinearModel], keep: list[str],
                 broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """model, keep..., margin, score = sigmoid(active weights summed + intercept).

    Weights within the bound are constants of a narrow projection of the design:
    no shuffle. The sigmoid is applied to all models (also to SVM margins), as the
    analysed workload does."""
    vectors = [_vector_of(m, broadcast_rows) for m in fitted]
    if all(v is not None for v in vectors):
        per = F.array(*[F.struct(F.lit(m.name).alias("model"), vector_margin(v).alias("margin"))
                        for m, v in zip(fitted, vectors, strict=True)])
        out = design.select(*keep, F.inline(per))
    else:
        slices = int(design.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        cells = cell_table(design.select("article_id", F.lit(0.0).alias("label"), "slots"), slices)
        out = None
        for m in fitted:
            got = cell_margins(cells, m.weights, slices).select("article_id", "margin")
            one = design.select(*keep).join(got, "article_id").select(F.lit(m.name).alias("model"), *keep, "margin")
            out = one if out is None else out.unionByName(one)
    return out.select("model", *keep, "margin", sigmoid("margin").alias("score"))


def score_many(labeled: DataFrame, encoded: DataFrame, fitted: list[LinearModel],
               keep: list[str], broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """:func:`score_design` of the articles of ``labeled``; ``encoded`` (with the columns
    ``keep``) holds their feature ids."""
    design = design_arrays(encoded, labeled, keep)
    return score_design(design, fitted, keep, broadcast_rows)


def score(labeled: DataFrame, encoded: DataFrame, model: LinearModel,
          keep: list[str], broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    return score_many(labeled, encoded, [model], keep, broadcast_rows)
