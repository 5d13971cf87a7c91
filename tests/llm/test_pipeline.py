"""The pipeline against its stages written out in plain Python and SQL."""

import duckdb
import pandas as pd
from pyspark.sql import functions as F

import corpus_pipeline
from sharecast.llm.oracle import MIX
from sharecast.llm.registry import default_vocabulary

from ..conftest import SF_SMALL
from . import brute


def brute_pipeline(rows):
    """[(id, text, source)] -> rows of the last stage"""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_vocabulary())
    source = {d: s for d, _, s in rows}
    judged = [(d, brute.quality(t)) for d, t, _ in rows]
    kept = [(d, q[0]) for d, q in judged if q[-1]]
    kept = [(d, t) for d, t, _, _ in brute.dedup_lines(kept)]
    group = brute.components(kept, 80, 100, n=5)
    kept = [(d, t) for d, t in kept if group[d] == d]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(d, t, source[d]) for d, t in kept], columns=["doc_id", "text", "source"]))
    sql = MIX.replace("SELECT e2.doc_id,", "SELECT e2.certain + CASE WHEN run.before + e2.size / 2.0::DOUBLE "
                      "<= run.need THEN 1 ELSE 0 END AS copies, e2.doc_id,")
    copies = {r[1]: r[0] for r in con.execute(sql).fetchall()}
    out = []
    for d, t in kept:
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        out += [(d, len(ids), brute.sha(b"".join(i.to_bytes(4, "little") for i in ids)), brute.sha(t))] * copies[d]
    return sorted(out)


def test_run_matches_its_stages_written_out(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    want = brute_pipeline([(r.doc_id, r.text, r.source) for r in docs.collect()])
    got = sorted(map(tuple, corpus_pipeline.run(spark, SF_SMALL).collect()))
    assert got == want and 50 < len(got)


def test_stages_keep_the_columns_and_stand_odd_rows(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_copies", "source_mix", "bpe"]
    good = "A clean sentence of words that says one thing, then another thing, and then it ends quietly here today."
    rows = [(i, f"{good} Number {i}.\nShared line.\n{'x ' * (i % 3)}", "en", "s" if i % 3 else None, 1) for i in range(40)]
    none = f"{good} It has no number at all."
    rows += [(None, none, None, None, None), (None, none, None, None, None), (7, rows[7][1], "en", "s", 1), (50, None, "en", "s", 0),
             (51, "", "en", "t", 0), (52, "w " * 30_000 + ".", "en", "t", 0), (53, "y" * 200_000, "en", "t", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("_text", F.lit(1)).withColumn("size", F.lit(1)).withColumn("component_id", F.lit(1))
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, empty = stage(spark, docs, SF_SMALL), stage(spark, empty, SF_SMALL)
        assert docs.columns == corpus_pipeline.COLUMNS == empty.columns, name
        assert docs.count() > 0 and empty.count() == 0, name
        if name == "near_copies":
            ids = [r.doc_id for r in docs.collect()]
            assert ids.count(7) <= 1 and ids.count(None) == 2
    name, last = corpus_pipeline.STAGES[-1]
    assert last(spark, docs, SF_SMALL).count() == docs.count() and last(spark, empty, SF_SMALL).count() == 0
