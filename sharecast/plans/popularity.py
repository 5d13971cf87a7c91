"""The popularity model, end to end.

articles → hash split → label → long features → dictionary (train only) →
encoded design table → gradient-descent fits (logistic, hinge) → scores →
log loss, ROC, AUC, selection.

Pinned tables in the shared folder: the labeled articles (bucketed by article),
the dictionary, the encoded design of all splits (one row per article), the
weights and the scores.
``sources.files.release_staged`` deletes them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate, features, models
from ..operators.labels import with_label
from ..operators.split import hash_split
from ..session import ensure_checkpoint_dir
from ..sources.files import pin_table, write_bucketed
from ..sources import articles as article_source
from ..sources.tables import table

KEEP = ["article_id", "split", "label"]


@dataclass
class Prepared:
    labeled: DataFrame            # article_id, split, label, rate, timedelta, shares, predictors
    predictors: list[str]
    long: DataFrame               # article_id, split, label, idx, value
    dictionary: DataFrame         # idx, value, n_rows, feature_id
    n_train: int
    _design: DataFrame | None = field(default=None, repr=False)
    _design_train: DataFrame | None = field(default=None, repr=False)

    def long_train(self) -> DataFrame:
        return self.long.filter(F.col("split") == F.lit("train"))

    def encoded(self, how: str = "inner") -> DataFrame:
        return features.encode_long(self.long, self.dictionary, how=how)

    def design(self) -> DataFrame:
        """All articles encoded, written once; training and scoring read it."""
        if self._design is None:
            self._design = models.design_table(self.encoded(), self.labeled, KEEP)
        return self._design

    def design_train(self) -> DataFrame:
        if self._design_train is None:
            # cached for the iterations (spills to disk); read again from the table if lost
            self._design_train = self.design().filter(F.col("split") == F.lit("train")).persist(
                StorageLevel.MEMORY_AND_DISK)
        return self._design_train

    def release(self) -> None:
        """Drop the cached training design (``files.release_staged`` deletes the tables)."""
        if self._design_train is not None:
            self._design_train.unpersist()
        self._design_train = None


def labeled_articles(spark: SparkSession, sf_dir: str, with_date: bool = False) -> DataFrame:
    arts = article_source.articles(spark, sf_dir, with_date)
    return with_label(hash_split(arts))


def prepare_table(labeled: DataFrame, predictors: list[str], rows: int | None = None) -> Prepared:
    """Pin a labeled, split table (article_id, split, label, predictors...) as
    an article-bucketed table, build the long form and fit the dictionary.
    ``rows``, if known, saves counting them (for the number of buckets)."""
    ensure_checkpoint_dir(labeled.sparkSession)
    pinned = write_bucketed(labeled, "labeled", "article_id", rows=labeled.count() if rows is None else rows)
    long = features.feature_long(pinned, predictors, KEEP)
    dictionary = features.fit_dictionary(long.filter(F.col("split") == F.lit("train")))
    n_train = pinned.filter(F.col("split") == F.lit("train")).count()
    return Prepared(pinned, predictors, long, dictionary, n_train)


def prepare(spark: SparkSession, sf_dir: str, with_date: bool = False) -> Prepared:
    """The article binding of the test tables, split by md5 of the order key."""
    return prepare_table(labeled_articles(spark, sf_dir, with_date), article_source.predictors(with_date),
                         rows=table(spark, sf_dir, "orders", "o_orderkey").count())


def prepare_file(spark: SparkSession, path: str) -> Prepared:
    """The 61-column article file: 58 string predictors, split by md5 of the url."""
    from ..schema import predictor_names

    arts = article_source.articles_from_file(spark, path)
    return prepare_table(with_label(hash_split(arts, key="url")), predictor_names())


def fit_model(prep: Prepared, loss: str, iterations: int, name: str | None = None,
              **kw) -> models.LinearModel:
    cfg = models.GDConfig(loss=loss, iterations=iterations, **kw)
    return models.fit(prep.design_train(), prep.dictionary, prep.n_train, cfg,
                      name or ("lr" if loss == "logistic" else "svm"))


def fit_both(prep: Prepared, iterations: int) -> list[models.LinearModel]:
    """Logistic regression and linear SVM, trained together (one scan of the
    design table per iteration for both)."""
    cfgs = [("lr", models.GDConfig(loss="logistic", iterations=iterations)),
            ("svm", models.GDConfig(loss="hinge", iterations=iterations))]
    return models.fit_many(prep.design_train(), prep.dictionary, prep.n_train, cfgs)


def scores(prep: Prepared, fitted: list[models.LinearModel]) -> DataFrame:
    """All models scored in one pass over the encoded articles."""
    return models.score_design(prep.design(), fitted, KEEP)


def model_weights(fitted: list[models.LinearModel]) -> DataFrame:
    out = None
    for m in fitted:
        w = m.weights.select(F.lit(m.name).alias("model"), "feature_id", "weight")
        out = w if out is None else out.unionByName(w)
    return out


class Evaluation:
    """Scores of the fitted models (written once) and metrics derived from them
    on first use: a caller that needs only the scores or the ROC curve does not
    pay for the AUC's distributed sort."""

    def __init__(self, scores: DataFrame, labeled: DataFrame):
        self.scores = scores
        self._labeled = labeled
        self._cache: dict[str, DataFrame] = {}

    def _get(self, key: str, build) -> DataFrame:
        if key not in self._cache:
            self._cache[key] = build()
        return self._cache[key]

    @property
    def log_loss(self) -> DataFrame:
        return self._get("log_loss", lambda: evaluate.log_loss_table(self.scores))

    @property
    def ranked(self) -> DataFrame:
        """Scores in order, sorted once for the ROC curve and the AUC."""
        return self._get("ranked", lambda: evaluate.ranked_scores(self.scores))

    @property
    def auc(self) -> DataFrame:
        return self._get("auc", lambda: evaluate.auc(self.scores, ranked=self.ranked))

    @property
    def roc(self) -> DataFrame:
        return self._get("roc", lambda: evaluate.roc_points(self.scores, ranked=self.ranked))

    @property
    def held_out(self) -> DataFrame:
        """Scores of the validation and test rows."""
        return self.scores.filter(F.col("split").isin("val", "test"))

    @property
    def held_out_ranked(self) -> DataFrame:
        """The held-out scores in order: ranks are per split, so their curves need no
        other rows sorted."""
        return self._get("held_out_ranked", lambda: evaluate.ranked_scores(self.held_out))

    @property
    def baseline(self) -> DataFrame:
        return self._get("baseline", lambda: evaluate.baseline_log_loss(self._labeled))


def evaluate_models(prep: Prepared, fitted: list[models.LinearModel]) -> Evaluation:
    return Evaluation(pin_table(scores(prep, fitted), "scores"), prep.labeled)
