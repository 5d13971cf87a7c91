"""The search holds one shard and little beside it, and passes scores from shard to shard."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from sharecast.llm import bm25_search

from . import brute


def segments_of(rows, parts):
    batches = [pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows[i::parts]], pa.int64()), pa.array([t for _, t in rows[i::parts]])],
                                          ["id", "text"]) for i in range(parts)]
    return [s for b in batches for s in bm25_search._index([b])]


def test_a_long_query_takes_little_memory_beside_the_index():
    n, words = 12_000, [f"w{i}" for i in range(100)]
    draw = random.Random(4)
    texts = [" ".join(draw.sample(words, 95)) for _ in range(n)]
    rows = [s.to_pylist()[0] for s in segments_of(list(enumerate(texts)), 4)]
    term, _, count, _ = bm25_search.term_counts([" ".join(words).encode()])
    postings = 95 * n
    tracemalloc.start()
    shard = bm25_search.Shard(rows, 95.0)
    built = tracemalloc.get_traced_memory()[0]
    tracemalloc.reset_peak()
    ids, scores, _ = shard.search(term, count * np.linspace(1.0, 2.0, len(term)), 10)
    searched = tracemalloc.get_traced_memory()[1] - built
    tracemalloc.stop()
    assert built < 14 * postings and searched < 8 * postings and len(ids) == 10 and not rows


def test_shards_of_a_task_give_the_best_of_all():
    draw = random.Random(5)
    words = [f"w{i}" for i in range(50)]
    rows = [(i, " ".join(draw.choices(words, [1 / (j + 1) for j in range(50)], k=draw.randrange(1, 40)))) for i in range(400)]
    rows += [(500 + i, "tie tie") for i in range(14)]
    queries = {i: rows[i][1] for i in range(0, 400, 50)} | {500: "tie w1"}
    batches = segments_of(rows, 7)
    term, doc, count, _ = bm25_search.term_counts([t.encode() for t in queries.values()])
    order = np.argsort(doc, kind="stable")
    held = [brute.ALNUM.findall(t) for _, t in rows]
    n, mean = len(rows), sum(map(len, held)) / len(rows)
    of = {int(bm25_search.term_counts([w.encode()])[0][0]): sum(w in h for h in held) for w in [*words, "tie"]}
    df = np.array([of[int(x)] for x in term])
    weight = (count * np.log(1 + (n - df + 0.5) / (df + 0.5)))[order]
    distinct, places = np.unique(term[order], return_inverse=True)

    class Block:
        value = (np.array(list(queries)), np.concatenate(([0], np.cumsum(np.bincount(doc)))), distinct, places, weight)

    for shard_words in (1, 3_000, 1 << 30):
        got = [r for b in bm25_search._search(10, mean, shard_words, Block)(iter(batches)) for r in b.to_pylist()]
        for q, text in queries.items():
            mine = [(r["doc_id"], r["score"]) for r in got if r["query_id"] == q]
            want = brute.bm25(rows, text)
            assert [d for d, _ in mine] == [d for d, _ in want]
            np.testing.assert_allclose([s for _, s in mine], [s for _, s in want], rtol=1e-9)
