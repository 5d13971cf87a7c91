"""Phrase mining, the Merkle manifest and exact deduplication against brute force."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from sharecast.llm import exact_dedup, merkle, phrase_mining

from ..conftest import SF_SMALL
from . import brute
from .test_native_operators import documents

# exact deduplication -----------------------------------------------------------


def copy_rows():
    rnd = random.Random(2)
    texts = ["a b", "a  b", " a b", "a b", "A b", "a b\t", "", None, "x" * 300_000, "x" * 299_999 + "y", "a\x0bb", "\n"]
    rows = [(i, texts[rnd.randrange(len(texts))]) for i in range(200)] + [(500 + i, "one text of a third of all") for i in range(150)]
    return rows + [(None, "only without ids"), (None, "only without ids"), (None, "a b"), (7, "twice"), (7, "twice"), (3, "twice"),
                   (3, "twice"), (-5, "a b")]


@pytest.mark.parametrize("how", [{}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "bloom_words": 0},
                                 {"digest": lambda c: F.unhex(F.substring(F.md5(c.cast("binary")), 1, 2))}])
def test_copies_match_brute_force_on_every_path(spark, how):
    rows = copy_rows()
    random.Random(3).shuffle(rows)
    df = documents(spark, rows).withColumn("_h", F.lit(1)).withColumn("kept", F.lit(1)).repartition(7)
    got = exact_dedup.exact_groups(df, **how).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=key) == sorted(brute.copies(rows), key=key)
    stay = [r for r in got if r.kept]
    assert len(stay) == len({r.text_sha256 for r in got}) == len({r.text_sha256 for r in stay})
    assert all(r.doc_id == r.keep_id for r in stay)


def test_copies_return_texts_and_stand_empty_tables(spark):
    df = documents(spark, [(2, "b  b"), (1, "b b"), (3, None), (4, "")])
    got = exact_dedup.drop_copies(df, keep=("source",)).collect()
    assert sorted((r.doc_id, r.text, r.source) for r in got) == [(1, "b b", "s"), (3, None, "s")]
    assert exact_dedup.exact_groups(df.limit(0)).count() == 0


# Merkle manifest ------------------------------------------------------------------

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def manifest_rows():
    rnd = random.Random(5)
    langs = ["en"] * 9 + ["de", "de", None, "", "é", "zz"]
    rows = [(i * 3 % 1009, rnd.choice(["s", None]), rnd.choice(langs), rnd.choice([None, i]), rnd.choice([None, "", "tä", f"t{i}"]))
            for i in range(600)]
    return rows + [(2000, "s", "lone", 1, "x" * 100_000), (None, "s", "en", 1, "a"), (None, "s", "en", 1, "a"), rows[0], rows[0]]


@pytest.mark.parametrize("k,levels", [(2, 12), (2, 3), (3, 2)])
def test_manifest_matches_brute_force(spark, k, levels):
    rows = manifest_rows()
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    df = df.withColumn("g", F.lit(1)).withColumn("pos", F.lit(1)).withColumn("path", F.lit(1)).repartition(5)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    made = merkle.manifest(df, COLUMNS, fan_out=k, levels=levels,
                           tampered={"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    got = merkle.verify(made).collect()
    leaves = [(r[0], r[2], brute.sha("".join(map(brute.field, r)))) for r in rows]
    want, root = brute.merkle(leaves, k)
    assert sorted((str(r.doc_id), r.leaf) for r in got) == sorted((str(d), leaf) for d, _, leaf in leaves)
    changed = {d for d, _, _, n, _ in rows if d is not None and n is not None and zlib.crc32(str(d).encode()) % 7 == 0}
    twice = {(d, x) for d, _, x in leaves if sum(y == (d, x) for y in [(a, c) for a, _, c in leaves]) > 1}
    for r in got:
        subroot, path = want[r.doc_id, r.leaf]
        assert (r.subroot, r.root) == (subroot, root)
        if (r.doc_id, r.leaf) not in twice:         # equal leaves are interchangeable
            assert [tuple(p) for p in r.path] == path
            assert r.proof_sha256 == brute.sha("".join(a + b for a, b in path))
        assert r.verified == (r.doc_id not in changed) == (r.folded_root == root)
    assert changed and len({r.lang for r in got}) == 7


def test_manifest_of_one_row_and_of_none(spark):
    df = spark.createDataFrame([(5, None)], "doc_id long, lang string")
    r = merkle.verify(merkle.manifest(df, ["doc_id", "lang"])).collect()[0]
    assert r.leaf == r.subroot == r.root == r.folded_root == brute.sha("1:5-") and r.path == [] and r.verified
    assert merkle.verify(merkle.manifest(df.limit(0), ["doc_id"])).count() == 0


def test_tree_windows_stay_in_blocks(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"))
    plan = merkle.manifest(df, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.split("\n") if "Window [" in x and ("lead(" in x or "last(" in x)]
    assert windows and all("[g#" in x and "_block#" in x for x in windows)


# phrase mining ----------------------------------------------------------------------


def phrase_rows(rnd, n):
    """Texts of a skewed vocabulary with set phrases, shared passages and odd bytes."""
    common = [f"w{i}" for i in range(40)]
    fixed = ["new york city", "as well as", "New  York", "x1 x2 x3 x4 x5 x6 x7", "état-major de", "q q r"]
    rows = []
    for i in range(n):
        words = [rnd.choice(fixed) if rnd.random() < 0.2 else common[min(int(rnd.expovariate(0.12)), 39)] for _ in range(rnd.randrange(60))]
        text = "".join(w + rnd.choice([" ", " ", " ", "\t", "  ", ", ", ".\n", "\x0b", ";"]) for w in words)
        rows.append((rnd.choice(["en", "en", "de", None]), text))
    copy = "the whole passage that many texts share, word for word and w1 w2 w3"
    return rows + [("en", copy)] * 150 + [("de", None), ("de", ""), ("fr", "lone words here"), ("es", "z " * 50_000)]


@pytest.mark.parametrize("top,least", [(2000, 100), (15, 20), (3, 5)])
def test_phrases_match_brute_force(spark, top, least):
    rows = phrase_rows(random.Random(7 + top), 700)
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("n", F.lit(1)).withColumn("code", F.lit(2)).repartition(6)
    got = phrase_mining.mine_phrases(df, top=top, min_count=least).collect()
    want = brute.phrases(rows, least, top)
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 3


def test_phrases_hold_with_tiny_filters_and_flushes(spark, monkeypatch):
    monkeypatch.setattr(phrase_mining, "FILTER_WORDS", 2)       # filters that turn nothing away
    rows = phrase_rows(random.Random(1), 300)
    got = phrase_mining.mine_phrases(spark.createDataFrame(rows, "lang string, text string"), top=20, min_count=10).collect()
    assert {tuple(r) for r in got} == brute.phrases(rows, 10, 20)


def test_chunks_hold_words_pieces_and_small_flushes(monkeypatch):
    codes, ids, vocabulary = phrase_mining.encode_chunk(["a", "b", "a"], ["X y, x!".encode(), b"", " x\ty z".encode()], 0)
    spelled = [None, *[v[:2] for v in vocabulary]]
    assert [spelled[i] for i in ids] == [None, ("a", b"x"), ("a", b"y"), None, ("a", b"x"), None, ("a", b"x"), ("a", b"y"), ("a", b"z")]
    assert dict(((x, y), n) for x, y, n in vocabulary) == {("a", b"x"): 3, ("a", b"y"): 2, ("a", b"z"): 1}
    assert codes[0] == 0 and len(codes) == 4


def test_phrases_of_no_rows(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    got = phrase_mining.mine_phrases(empty)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and got.count() == 0
    assert phrase_mining.mine_phrases(spark.createDataFrame([("en", None), (None, "a b")], "lang string, text string")).count() == 0


def test_phrases_of_a_table_match(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    want = brute.phrases([(r.lang, r.text) for r in docs.collect()], 10, 60)
    assert {tuple(r) for r in phrase_mining.mine_phrases(docs, top=60, min_count=10).collect()} == want and len(want) > 100
