"""The pipeline's near-copy stage: five-word shingles, Jaccard from 0.8 up."""

import random

import numpy as np

import corpus_pipeline
from sharecast.llm import jaccard_join

from ..conftest import SF_SMALL
from . import brute
from .test_search_and_dedup import near_texts


def test_every_pair_of_the_stage_shares_a_key():
    texts = near_texts(random.Random(4), 250)
    sets = [brute.shingles(t, 5) for t in texts]
    grams, offsets = jaccard_join.ngram_sets([t.encode() for t in texts], 5)
    assert list(np.diff(offsets)) == [len(s) for s in sets]
    keys, of = jaccard_join.candidate_keys(grams, offsets, 80, 100)
    by = {}
    for k, d in zip(keys.tolist(), of.tolist(), strict=True):
        by.setdefault(d, set()).add(k)
    links = [(i, j) for i in range(len(sets)) for j in range(i)
             if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert len(links) > 100 and all(by[i] & by[j] for i, j in links)


def test_long_sets_leave_few_groups_empty_beyond_the_spare():
    rng = np.random.default_rng(5)
    for num in (80, 90):
        for size in (200, 3_000, 20_000):
            grams = rng.integers(0, 2 ** 63, 3 * size).astype(np.uint64)
            keys, of = jaccard_join.candidate_keys(grams, np.arange(4) * size, num, 100)
            assert np.bincount(of).max() <= size, (num, size)     # millions at 0.8 with two spare groups
    assert jaccard_join.spare_groups(1000, 500) == jaccard_join.SPARE      # a threshold too low for any number


def test_copies_between_the_two_thresholds_go(spark):
    long = [f"a{i}" for i in range(100)]
    short = [f"b{i}" for i in range(50)]
    rows = [(1, long), (2, long + [f"t{i}" for i in range(12)]), (3, short), (4, short[:25] + ["x"] + short[26:]),
            (5, long[:70] + [f"u{i}" for i in range(30)])]
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", 1) for i, w in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_copies(spark, docs, SF_SMALL).collect()
    # (1, 2) and (3, 4): 0.889 and 0.804 on five words; the second pair is inside a run: 41 of 51 shingles
    assert sorted(r.doc_id for r in got) == [1, 3, 5]


def test_different_texts_of_one_id_are_documents_of_their_own(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcde"}
    rows = [(1, text["a"], "en", "s", 1), (1, text["b"], "en", "s", 1), (1, text["b"], "en", "r", 1), (2, text["c"], "en", "s", 1),
            (3, text["b"] + " end", "en", "s", 1), (3, text["d"], None, None, 1), (3, None, "en", "s", 0),
            (None, text["e"], "en", "s", 1), (None, text["e"], "en", "s", 1)]
    want = sorted([(1, text["a"], "s"), (1, text["b"], "r"), (2, text["c"], "s"), (3, text["d"], None), (3, None, "s"),
                   (None, text["e"], "s"), (None, text["e"], "s")], key=str)
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, lang string, source string, n_chars long")
        got = corpus_pipeline.near_copies(spark, docs.repartition(5), SF_SMALL).collect()
        assert sorted([(r.doc_id, r.text, r.source) for r in got], key=str) == want


def test_a_shared_passage_is_verified_without_pairs(spark, monkeypatch):
    """Thousands of texts with one passage: one candidate cluster, few sets left to compare."""
    rnd = random.Random(11)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(2500):
        own = [f"{i}.{k}" for k in range(rnd.randrange(30, 60))]
        at = rnd.randrange(len(own))
        rows.append((i, " ".join(own[:at] + passage + own[at:])))
    for i in range(60):                                     # and true copies with a changed end
        rows.append((3000 + i, rows[i * 7][1] + " tail" * (i % 3)))
    rows += [(4000 + i, " ".join(passage + [f"{i}"])) for i in range(30)]
    seen = []
    monkeypatch.setattr(jaccard_join, "BLOCK_ITEMS", 2000)
    block_tasks = jaccard_join._block_tasks

    def counted(sets, num, den):
        tasks = block_tasks(sets, num, den)
        seen.append((sets.count(), tasks.count()))
        return tasks

    monkeypatch.setattr(jaccard_join, "_block_tasks", counted)
    # keys of single shingles chain all texts of the passage
    monkeypatch.setattr(jaccard_join, "candidate_keys", lambda g, o, num, den: (g, np.repeat(np.arange(len(o) - 1), np.diff(o))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.component_id for r in jaccard_join.similar_groups(df, n=5, num=80, den=100).collect()}
    assert got == brute.components(rows, 80, 100, n=5)
    (left, compared), = seen
    assert 30 < left < 200 and compared < 10 * left         # of 2,590 sets
