"""The same plan on another labelled table: documents ⋈ labels (label = quality;
predictors: language, source, length bucket)."""

from pyspark.sql import functions as F

from sharecast.operators.split import hash_split
from sharecast.plans import popularity as P
from sharecast.sources.tables import table

from .conftest import SF_MID


def test_documents_quality_model(spark):
    docs = table(spark, SF_MID, "documents", "doc_id", "lang", "source", "n_chars")
    labels = table(spark, SF_MID, "labels", "doc_id", "quality")
    labeled = (docs.join(labels, "doc_id")
               .select(F.col("doc_id").alias("article_id"), "lang", "source",
                       F.floor(F.log10(F.col("n_chars") + 1)).cast("string").alias("length"),
                       F.col("quality").cast("double").alias("label")))
    labeled = hash_split(labeled)
    prep = P.prepare_table(labeled, ["lang", "source", "length"])
    assert prep.labeled.count() == labels.join(docs, "doc_id").count()
    fitted = P.fit_both(prep, 3)
    ev = P.evaluate_models(prep, fitted)
    rows = ev.log_loss.collect()
    assert {(r.model, r.split) for r in rows} == {(m, s) for m in ("lr", "svm")
                                                  for s in ("train", "val", "test")}
    assert all(r.log_loss > 0 for r in rows)
