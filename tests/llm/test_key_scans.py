"""Keys of documents and the links that scans of them make."""

import random

import numpy as np

from sharecast.llm import jaccard_join


def test_links_of_near_copies_do_not_grow_with_the_number_of_tasks(spark, monkeypatch):
    draw, rows = random.Random(1), []
    for i in range(40):
        words = [f"w{draw.randrange(10 ** 9)}" for _ in range(300)]
        for copy in range(3):
            rows.append((3 * i + copy, " ".join(words)))
            words[draw.randrange(300)] = "changed"
    made, inner = [], jaccard_join.connected_components

    def counted(edges, *args, **kw):
        if kw.get("shortened"):
            made.append(edges.count())
        return inner(edges, *args, **kw)

    monkeypatch.setattr(jaccard_join, "connected_components", counted)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(24)
        got = {r.doc_id: r.component_id for r in jaccard_join.similar_groups(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {d: d // 3 * 3 for d, _ in rows}
    assert sum(made) <= 8 * len(rows)


def test_document_keys_are_those_of_the_sets():
    import pyarrow as pa

    texts = ["a b c d", None, "", " ".join(f"x{i}" for i in range(200)), "a b c d"]
    made = list(jaccard_join._document_keys(3, 90, 100)([pa.RecordBatch.from_arrays(
        [pa.array([5, 6, 7, 8, 9]), pa.array(texts)], ["id", "text"])]))
    got = {i: np.frombuffer(k, np.uint64).tolist() for b in made for i, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
    keys, of = jaccard_join.candidate_keys(*jaccard_join.ngram_sets([(t or "").encode() for t in texts], 3), 90, 100)
    assert got == {i + 5: sorted(set(keys[of == i].tolist())) for i in (0, 3, 4)}
