"""Operators with Python tasks, against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from sharecast.llm import bm25_search, bpe, components, jaccard_join, suffix_dedup
from sharecast.llm.registry import default_vocabulary

from ..conftest import SF_MID, SF_SMALL
from . import brute
from .test_native_operators import documents


def rows_of(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


# components ----------------------------------------------------------------

def test_components_match_union_find(spark):
    rnd = random.Random(1)
    perm = list(range(400))
    rnd.shuffle(perm)
    edges = [(perm[i], perm[i + 1]) for i in range(399) if i % 50]            # paths in random order
    edges += [(rnd.randrange(400, 900), rnd.randrange(400, 900)) for _ in range(300)] + [(950, 950), (None, 3)]
    edges += [(1000 + i, 2000) for i in range(500)] + edges[:20]              # a hub, repeated edges
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r.node: r.component for r in got} == {v: root(v) for v in up}
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


@pytest.mark.parametrize("chunk", [5, 1000])
def test_shortened_edges_are_stars_of_the_same_components(monkeypatch, chunk):
    monkeypatch.setattr(components, "CHUNK_EDGES", chunk)
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(rnd.randrange(50, 90), rnd.randrange(50, 90)) for _ in range(30)]
    edges += [(99, 99), (99, 99), (70, 70)] + edges[:4]
    rnd.shuffle(edges)
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*edges[i:i + 3], strict=True)], ["a", "b"])
               for i in range(0, len(edges), 3)] + [pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["a", "b"])]
    out = [tuple(r.values()) for b in components.shorten(batches) for r in b.to_pylist()]

    def labels(pairs):
        nodes, least = components.least_vertices(*np.array(pairs).T)
        return dict(zip(nodes.tolist(), least.tolist(), strict=True))

    assert labels(out) == labels(edges) and all(a >= b for a, b in out)
    if chunk > len(edges):
        label = labels(edges)
        alone = {r for r in label if list(label.values()).count(r) == 1}          # loops only
        assert 99 in alone and sorted(out) == sorted((v, r) for v, r in label.items() if v != r or v in alone)
    assert list(components.shorten([])) == []


def test_contraction_in_small_chunks_keeps_components(monkeypatch):
    monkeypatch.setattr(components, "CHUNK_EDGES", 7)
    rnd = random.Random(8)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(50)] + [(99, 98 - i) for i in range(30)]
    now = edges
    for _ in range(12):                                   # rounds of one task each
        ends = sorted((e, a, b) for a, b in now for e in {a, b})
        batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*ends[i:i + 3], strict=True)], ["end", "a", "b"])
                   for i in range(0, len(ends), 3)]
        out = [r for b in components._round(batches) for r in b.to_pylist()]
        now = [(r["a"], r["b"]) for r in out]
        if not any(r["new"] for r in out):
            break
    else:
        raise AssertionError("no end")
    nodes, least = components.least_vertices(*map(np.array, zip(*edges, strict=True)))
    want = dict(zip(nodes.tolist(), least.tolist(), strict=True))
    assert {a: b for a, b in now if a != b} == {a: b for a, b in want.items() if a != b}


# Jaccard join --------------------------------------------------------------

def near_texts(rnd, groups):
    vocab, out = [f"w{i}" for i in range(300)], []
    for _ in range(groups):
        n = rnd.choice([0, 1, 2, 3, 5, 9, 11, 12, 13, 18, 20, 22, 25, 30, 40, 60, 90, 140])
        w = [rnd.choice(vocab) for _ in range(n)]
        for _ in range(rnd.randrange(1, 6)):
            v = list(w)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, max(1, n // 40)])):
                if v:
                    v[rnd.randrange(len(v))] = rnd.choice(vocab) if rnd.random() < 0.4 else v[0].upper()
            out.append(rnd.choice([" ", "\n", "\t "]).join(v))
    return out


def test_every_linked_pair_shares_a_key():
    texts = near_texts(random.Random(0), 250)
    sets = [brute.shingles(t) for t in texts]
    grams, offsets = jaccard_join.ngram_sets([t.encode() for t in texts])
    assert list(np.diff(offsets)) == [len(s) for s in sets]
    keys, of = jaccard_join.candidate_keys(grams, offsets, 90, 100)
    by = {}
    for k, d in zip(keys.tolist(), of.tolist(), strict=True):
        by.setdefault(d, set()).add(k)
    links = [(i, j) for i in range(len(sets)) for j in range(i)
             if sets[i] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])]
    assert len(links) > 100 and all(by[i] & by[j] for i, j in links)


def test_boundary_is_where_subsets_cost_more():
    x = jaccard_join.boundary(90, 100)
    assert 10 < x < 40
    assert jaccard_join.boundary(50, 100) < x          # looser thresholds ask for more subsets


@pytest.mark.parametrize("blocks", [1_000_000, 300])
def test_groups_match_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(jaccard_join, "BLOCK_ITEMS", blocks)       # small: clusters of several blocks
    rnd = random.Random(2)
    base = [f"b{i}" for i in range(60)]
    texts = near_texts(rnd, 60) + [" ".join(base[:i] + ["x"] + base[i + 1:]) for i in range(0, 60, 4)]
    rows = list(enumerate(texts)) + [(900 + i, texts[-1]) for i in range(20)]
    rows += [(None, texts[-1]), (None, None), (990, None), (991, " \n"), (992, "one"), (993, "ONE"), rows[7], (7, texts[40]),
             (994, "long " * 60_000), (995, "long " * 59_999 + "longer")]
    got = jaccard_join.similar_groups(documents(spark, rows)).collect()
    want = brute.components(rows)
    assert len(got) == len(rows)
    sizes = {}
    for d, t in rows:
        sizes.setdefault(d, set()).add(len(brute.shingles(t)))
    for r in got:
        assert r.n_shingles in sizes[r.doc_id]
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None)
    assert jaccard_join.similar_groups(documents(spark, []).limit(0)).count() == 0


def test_jaccard_query_matches_brute_force(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in entry.queries()["op9_jaccard_join"](spark, SF_SMALL).collect()}
    rows = rows_of(spark, SF_SMALL)
    want = brute.components(rows)
    assert got == {d: (len(brute.shingles(t)), want[d]) for d, t in rows}


# suffix dedup --------------------------------------------------------------

def test_column_wise_order_is_the_suffix_order():
    rnd = random.Random(3)
    strings = [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(0, 40))) for _ in range(50)] + [b"a" * 80, b"", b"a" * 80]
    who, size, lcp = suffix_dedup.column_wise_order(strings)
    got = [strings[w][len(strings[w]) - n:] for w, n in zip(who, size, strict=True)]
    want = sorted(((s[len(s) - n:], i) for i, s in enumerate(strings) for n in range(len(s) + 1)))
    assert got == [w[0] for w in want] and who.tolist() == [w[1] for w in want]
    for a, b, n in zip(got, got[1:], lcp[1:], strict=False):
        same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert same == n


def test_order_with_sorted_ends():
    rnd = random.Random(13)
    left = [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(0, 9))) for _ in range(80)]
    parts = [bytes(rnd.choice(b"ab\x00") for _ in range(rnd.randrange(0, 12))) for _ in range(80)]
    who, size, lcp = suffix_dedup.column_wise_order(left, parts)
    for n in range(9):                                 # suffixes of one length are in byte order
        at = np.flatnonzero(size == n)
        texts = [left[w][len(left[w]) - n:] + parts[w] for w in who[at]]
        assert texts == sorted(texts)
        for (i, j), a, b in zip(zip(at, at[1:], strict=False), texts, texts[1:], strict=False):
            same = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert min(lcp[i + 1:j + 1]) == (same if j == i + 1 or same >= n else min(lcp[i + 1:j + 1]))


@pytest.mark.parametrize("strings", [8192, 5])
def test_repeats_match_brute_force(spark, monkeypatch, strings):
    monkeypatch.setattr(suffix_dedup, "STRINGS", strings)           # small: k-grams dealt to several blocks
    rnd = random.Random(4)

    def text(n):
        return "".join(rnd.choice("abcdefgh é\n") for _ in range(n))

    passage, far = text(160), text(99)
    rows = [(i, text(rnd.randrange(0, 150)) + passage[rnd.randrange(0, 50):] + text(rnd.randrange(0, 120))) for i in range(30)]
    rows += [(100 + i, far + "z" + text(5)) for i in range(5)]                 # 99 equal bytes stay
    rows += [(200 + i, rows[3][1]) for i in range(10)] + [(300, "a" * 500), (301, "a" * 250), (302, passage * 3)]
    rows += [(400, None), (401, ""), (402, text(600_000) + passage + "end")]
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.repeat_digests(suffix_dedup.remove_repeats(documents(spark, rows))).collect()}
    assert got == brute.repeats([(d, (t or "").encode()) for d, t in sorted(rows)])


def test_repeats_with_null_and_repeated_ids(spark):
    rnd = random.Random(5)
    a, b, c = ("".join(rnd.choice("abcdefgh ") for _ in range(200)) for _ in range(3))
    rows = [(2, a), (2, a), (1, b), (1, c), (None, a), (None, b + "!"), (3, c)]
    got = suffix_dedup.remove_repeats(documents(spark, rows)).collect()
    left = sorted((r.doc_id if r.doc_id is not None else 99, r.n_bytes, len(r.kept)) for r in got)
    # id 1 holds b and c; id 2 is one document given twice; null ids come last
    assert left == [(1, 200, 200), (1, 200, 200), (2, 200, 200), (2, 200, 200), (3, 200, 0), (99, 200, 0), (99, 201, 1)]
    assert suffix_dedup.remove_repeats(documents(spark, []).limit(0)).count() == 0


def test_suffix_query_matches_brute_force(spark):
    got = {r.doc_id: tuple(r)[1:] for r in entry.queries()["op7_suffix_dedup"](spark, SF_SMALL).collect()}
    assert got == brute.repeats([(d, (t or "").encode()) for d, t in sorted(rows_of(spark, SF_SMALL))])


# BPE -----------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(default_vocabulary())


def odd_texts():
    rnd = random.Random(6)
    alphabet = " \t\n\r\x0b\x1c\x85 　abcdeé日本語1２½'stredmll<|>endoftext🙂👩‍👧!?.-  "
    out = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(40))) for _ in range(2500)]
    return out + ["a<|endoftext|>b", "<|endoftext|><|endoftext|> ", "", " ", "  ", "a  b", "a \n b", "a" * 1050, "x" * 50_000,
                  "    " * 100 + "y", "'s 's don't we'll", "ab" * 30_000, "word " * 40_000]


def test_encoder_equals_the_library(library):
    with open(default_vocabulary(), "rb") as f:
        encoder = bpe.Encoder(f.read(), cache=500)               # small: caches are emptied often
    rnd = random.Random(7)
    texts = odd_texts() + [b"".join(encoder.bytes_of[rnd.randrange(50257)] for _ in range(6)).decode("utf-8", "ignore")
                           for _ in range(2000)]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = encoder.encode(text)
        assert list(bpe.unpack(ids)) == want.ids, text[:60]
        assert encoder.decode(ids) == library.decode(want.ids, skip_special_tokens=False)
    assert encoder.decode(bpe.pack([15496, 4_000_000])) == "Hello"      # an id that is not in the vocabulary


def test_bpe_query_and_defined_cases(spark, library):
    rows = list(enumerate(odd_texts()[-200:])) + [(None, "null id"), (900, None), (0, "again")]
    path = default_vocabulary()
    got = bpe.token_digests(bpe.decode_ids(bpe.encode_texts(documents(spark, rows), path), path)).collect()
    seen = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got)
    want = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d if d is not None else -1, len(ids), brute.sha(b"".join(i.to_bytes(4, "little") for i in ids)), brute.sha(t or "")))
    assert seen == sorted(want)
    assert bpe.encode_texts(documents(spark, []).limit(0), path).count() == 0
    got = {r.doc_id: r for r in entry.queries()["op8_bpe"](spark, SF_SMALL).collect()}
    for d, t in rows_of(spark, SF_SMALL):
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[d].ids_sha256 == brute.sha(b"".join(i.to_bytes(4, "little") for i in ids)) and got[d].decoded_sha256 == brute.sha(t)


# BM25 ----------------------------------------------------------------------

def check_search(got, rows, queries, k=10):
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.doc_id, r.score))
    for q, text in queries.items():
        want = brute.bm25(rows, text, k)
        have = sorted(by.get(q, []))
        assert [h[0] for h in have] == list(range(1, len(want) + 1))
        assert [h[1] for h in have] == [w[0] for w in want], (q, have, want)
        assert [h[2] for h in have] == pytest.approx([w[1] for w in want], rel=1e-9)


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
def test_search_query_matches_brute_force(spark, sf):
    rows = rows_of(spark, sf)
    got = entry.queries()["op5_bm25_search"](spark, sf).collect()
    check_search(got, rows, {d: t for d, t in rows if d % 100 == 0})


def test_search_repeated_rows_and_query_ids(spark):
    rows = [(1, "a b"), (1, "a b"), (2, "a c c"), (3, "z"), (4, "b")]
    index = bm25_search.build_index(documents(spark, rows).repartition(3))
    got = bm25_search.search(index, documents(spark, [(7, "a b"), (7, "a"), (8, "q")])).collect()
    assert sorted(r.doc_id for r in got) == [1, 1, 2, 4]
    check_search(got, rows, {7: "a b a", 8: "q"})


@pytest.mark.parametrize("small", [False, True])
def test_search_cases(spark, monkeypatch, small):
    if small:                                   # many segments, shards, query blocks and doc blocks
        monkeypatch.setattr(bm25_search, "SHARD_WORDS", 400)
        monkeypatch.setattr(bm25_search, "BLOCK_TERMS", 50)
    rnd = random.Random(9)
    vocab = [f"t{i}" for i in range(60)]
    rows = [(i, " ".join(rnd.choices(vocab, [1 / (j + 1) for j in range(60)], k=rnd.randrange(0, 60)))) for i in range(300)]
    rows += [(400 + i, "tie tie tie") for i in range(15)] + [(500, None), (501, ""), (502, "only-here, É é"), (503, "t1 " * 30_000)]
    rows = rows + [(None, "t1 t2")]
    queries = {i: rows[i][1] for i in range(0, 300, 25)} | {400: "tie", 500: None, 502: "É only", 503: "t1 t2 t3"}
    index = bm25_search.build_index(documents(spark, rows).repartition(5))
    got = bm25_search.search(index, documents(spark, list(queries.items()) + [(None, "t1")])).collect()
    check_search(got, rows, queries)
    none = bm25_search.build_index(documents(spark, []).limit(0))
    assert bm25_search.search(none, documents(spark, rows)).count() == 0
    assert bm25_search.search(index, documents(spark, []).limit(0)).count() == 0


def test_pruning_scores_few_documents():
    rnd = random.Random(10)
    n, common = 4000, [f"c{i}" for i in range(30)]
    texts = [" ".join(rnd.choices(common, k=30) + ([f"r{i % 400}"] * 2)) for i in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(texts)], ["id", "text"])
    segments = [s for b in bm25_search._index([batch]) for s in b.to_pylist()]
    shard = bm25_search.Shard(segments, 32.0)
    term, _, count, _ = bm25_search.term_counts([b"r7 r7 c1 c2 c3"])
    df = np.array([(shard.start[i + 1] - shard.start[i]) for i in np.searchsorted(shard.terms, term)])
    weights = count * np.log(1 + (n - df + 0.5) / (df + 0.5))
    ids, score, scored = shard.search(term, weights, 5)
    assert len(ids) == 5 and scored < n // 10
    want = brute.bm25(list(enumerate(texts)), "r7 r7 c1 c2 c3", 5)
    assert ids.tolist() == [w[0] for w in want]
