"""Operators that are plain DataFrame plans: oracle rows, properties, defined cases."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sharecast.llm import chat_format, license_scan, line_dedup, quality_rules, source_mix, url_filter
from sharecast.llm.common import pick
from sharecast.llm.oracle import ORACLE_SQL
from tools.check_oracle import compare, duck

from ..conftest import SF_MID, SF_SMALL
from . import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """Rows (id, text[, source]) with extra columns whose names clash with inner ones."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    return (df.withColumn("_text", F.lit(7)).withColumn("words", F.lit(8)).withColumn("rank", F.lit(9))
            .withColumn("blocks", F.lit(1)).withColumn("spans", F.lit(1)))


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
@pytest.mark.parametrize("key", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf, key):
    r = compare(spark, duck(sf), sf, key, entry.oracle_sql()[key])
    assert r["cols_match"] and r["types_match"] and r["values_match"], r


def test_plans_have_no_python(spark):
    for key in ("op1_chat_format", "op2_line_dedup", "op3_url_filter", "op4_source_mix", "op6_quality_rules",
                "op10_license_scan", "op13_exact_dedup"):
        plan = entry.queries()[key](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop")), key


def test_pick_resolves_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", "b")], "id long, text string, other string").toDF("id", "text", "TEXT")
    assert pick(df, ["text"]).collect()[0][0] == "a"
    assert pick(df, ["TEXT"]).collect()[0][0] == "b"
    with pytest.raises(ValueError):
        pick(df, ["missing"])


# chat formatting -----------------------------------------------------------

CONV = "conv_id long, turn long, role string, text string"


def test_chat_examples_are_prefixes_with_one_trainable_reply(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi <|im_end|>"), (1, 2, "assistant", "<\\|x|> a<"),
            (1, 3, "user", "more"), (1, 4, "assistant", ""), (1, 5, "user", "bye")]
    got = chat_format.prefix_target_examples(spark.createDataFrame(rows, CONV)).orderBy("position").collect()
    assert [(r.position, r.is_target) for r in got] == [(2, True), (4, True), (5, False)]
    assert got[1].text.startswith(got[0].text) and got[2].text.startswith(got[1].text)
    reply = got[0].text[got[0].loss_start:got[0].loss_start + got[0].loss_chars]
    assert reply == "<\\\\|x|> a<" and got[0].text.endswith(reply + "<|im_end|>\n")
    assert got[2].loss_start is None and got[2].loss_chars == 0
    assert got[2].text.count("<|im_start|>") == 6 and got[2].text.count("<|im_end|>") == 6


def test_chat_round_trip_and_defined_cases(spark):
    rnd = random.Random(3)
    odd = ["", None, "<|im_start|>user\nx<|im_end|>\n", "<\\|", "<<|", "|>", "a\n\nb", "é🙂" * 50, "x" * 200_000, "%0A<%"]
    rows = [(c, t, rnd.choice(["user", "assistant", None, "a\nb%<|"]), rnd.choice(odd))
            for c in (1, 2, 3, None) for t in [0, 1, 1, 2, None, 3]]
    rows += rows[:3]
    df = spark.createDataFrame(rows, CONV).withColumn("turns", F.lit(1)).withColumn("position", F.lit(2))
    examples = chat_format.prefix_target_examples(df)
    got = {r.conv_id: r for r in chat_format.conversation_digests(examples).collect()}
    for c in (1, 2, 3, None):
        def nulls_first(r):
            return tuple((x is not None, x or 0) for x in r[1:2]) + ((r[2] or ""), (r[3] or ""))
        mine = sorted((r for r in rows if r[0] == c), key=nulls_first)
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert got[c].n_turns == len(mine) and got[c].turns_sha256 == brute.sha(turns)
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == brute.sha(loss)
    assert chat_format.conversation_digests(
        chat_format.prefix_target_examples(spark.createDataFrame([], CONV))).count() == 0


# line dedup ----------------------------------------------------------------

def test_lines_match_brute_force(spark):
    rnd = random.Random(4)
    pool = [" Home | Login ", "home | login", "", "  ", "É", "é", "Same line.", "\tSAME LINE.\r"] + [f"l{i}" for i in range(30)]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(0, 12)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, "Same line.\nx"), (None, "l1"), rows[5], rows[5], (5, "other\nl2"),
             (103, "Same line.\n" * 3000 + "end")]
    got = line_dedup.dedup_lines(documents(spark, rows), min_docs=10).collect()
    want = brute.dedup_lines(rows, 10)
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got), key=key) == sorted(want, key=key)
    assert line_dedup.dedup_lines(documents(spark, []).limit(0)).count() == 0


# URL filter ----------------------------------------------------------------

def test_urls_match_a_scan_of_all_rules(spark):
    rnd = random.Random(5)
    hosts = ["com", "example.com", "a.example.com", "EXAMPLE.com", "badexample.com", "x.net", "net", "", "a..b", "a."]
    paths = ["", "/", "/en", "/en/", "/en/a", "/enx/", "/es/b/c", "//", "/en/a/b/c/d/e"]
    urls = [f"{rnd.choice(['http', 'ftp', ''])}://{rnd.choice(hosts)}{rnd.choice(paths)}{rnd.choice(['', '?q=://x/', '#f'])}"
            for _ in range(300)] + [None, "", "no scheme", "http:/x", "http://h" + ".d" * 300 + "/p" * 5000, "a\n://com/\nb"]
    rules = [("com", "/", "allow"), ("example.com", "/en", "block"), ("example.com", "/en/", "block"),
             ("a.example.com", "/en/", "allow"), ("net", "/es/b", "block"), ("net", "/es/b", "allow"), ("net", None, "allow"),
             (None, "/", "block"), ("x.net", "/es/", None), ("com", "/", "allow"), ("", "", "block"), ("b", "", "block")]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(None, urls[0]), (0, urls[0])], "page_id long, url string")
    pages = pages.withColumn("host", F.lit("clash")).withColumn("verdict", F.lit(1))
    got = url_filter.filter_urls(pages, url_filter.rules_table(spark, rules)).collect()
    assert len(got) == len(urls) + 2

    def judge(url):
        if not url or "://" not in url:
            host = path = ""
        else:
            rest = url.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host, rest = brute.lower(rest[:cut]), rest[cut:]
            path = rest[:min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
        best = None
        for h, p, v in rules:
            if h is None or v is None:
                continue
            p = p or ""
            if (host == h or host.endswith("." + h)) and path.startswith(p):
                best = max(best or (-1,), (len(h) + len(p), len(h), v == "block", h + p, v))
        return host, path, best[3] if best else None, best[4] if best else "allow"

    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == judge(urls[r.page_id] if r.page_id is not None else urls[0])
    none = url_filter.filter_urls(pages, url_filter.rules_table(spark, []))
    assert {(r.rule, r.verdict) for r in none.collect()} == {(None, "allow")}
    assert url_filter.filter_urls(pages.limit(0), url_filter.rules_table(spark, rules)).count() == 0
    big = [(f"h{i}.com", "/", "block") for i in range(50)] + rules
    by_shuffle = url_filter.filter_urls(pages.filter("page_id < 50"), url_filter.rules_table(spark, big).hint("merge"))
    assert all((r.host, r.path, r.rule, r.verdict) == judge(urls[r.page_id]) for r in by_shuffle.collect())


# mixing --------------------------------------------------------------------

def test_mix_meets_targets_and_reruns_agree(spark):
    rnd = random.Random(6)
    rows = [(i, "w " * rnd.choice([0, 1, 5, 50, 300, 2000]), rnd.choice(["a", "b", "b", "b", "c", "Z", None])) for i in range(1500)]
    rows += [(None, "x y z", "a"), rows[3], rows[3], (9999, None, "only empty")]
    df = documents(spark, rows)
    got = source_mix.mix_sources(df).collect()
    assert len(got) == len(rows)
    again = source_mix.mix_sources(df.repartition(7)).collect()
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.size, r.taken)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str), key
    total = sum(r.size for r in got)
    per = {}
    for r in got:
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        s = per.setdefault(r.source, [0, 0, r.target, 0])
        s[0], s[1], s[3] = s[0] + r.size, s[1] + r.taken, max(s[3], r.size)
        assert r.target <= 2 * r.source_size + 1e-9
    assert abs(sum(s[2] for s in per.values()) - 1.5 * total) < 1e-6 * total
    for s in per.values():
        assert abs(s[1] - s[2]) <= s[3] / 2 + 3        # a repeated row may add its few words
    assert source_mix.mix_sources(df.limit(0)).count() == 0


def test_mix_water_level_and_weights(spark):
    rows = spark.createDataFrame([("a", 100, 0), ("b", 1000, 0), (None, 50, 0), ("c", 10, 0)],
                                 "source string, words long, _gwords long")
    got = {r.source: r for r in source_mix.source_targets(rows).collect()}
    assert {k: v.weight for k, v in got.items()} == {"a": 3, "b": 1, "c": 2, None: 3}
    # 1740 words to share; a, c and the null source fill up at twice their words
    assert (got["a"].target, got["c"].target, got[None].target) == (200, 20, 100)
    assert got["b"].target == pytest.approx(1420)


def test_inclusion_follows_the_expected_copies(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a b c d e f g h i j")
                                    .otherwise(F.repeat(F.lit("w "), 400)).alias("text"), F.lit("s").alias("source"))
    share = {r.size: r.c for r in source_mix.mix_sources(docs, budget_pct=50).groupBy("size")
             .agg(F.avg("copies").alias("c")).collect()}
    assert share[10] < share[400] and 0.2 < share[10] < 0.6        # long documents are likelier, short ones stay


# quality -------------------------------------------------------------------

def test_quality_matches_brute_force(spark):
    rnd = random.Random(7)
    prose = ["the cat sat on the mat, quietly.", "one two three four five six seven eight nine ten eleven twelve thirteen",
             "Home | About | Contact | Login", "BUY!! NOW!! BEST!! PRICE!! EVER!!", "a### b*** c$$$ d%%%", "All rights reserved.",
             "x", "", "  ", "same words same words same words same words same words.", "\tEt voilà… c'est ça.", "50% of users"]
    texts = ["\n".join(rnd.choice(prose) for _ in range(rnd.randrange(0, 14))) for _ in range(150)]
    texts += [None, "", "\n", "w " * 30_000, " ".join(f"w{i}" for i in range(20_000)), "x" * 300_000]
    got = quality_rules.apply_quality_rules(documents(spark, list(enumerate(texts)) + [(None, texts[0]), (0, texts[0])])).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        want = brute.quality(texts[r.doc_id or 0])
        assert (r.text, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == want
    assert quality_rules.apply_quality_rules(documents(spark, []).limit(0)).count() == 0


def test_quality_keeps_good_and_rejects_bad_labels(spark):
    got = (entry.queries()["op6_quality_rules"](spark, SF_MID)
           .join(spark.read.parquet(f"{SF_MID}/labels.parquet"), "doc_id").filter("not base_failed")
           .groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect())
    share = {r.quality: r.k for r in got}
    assert share[1] == 1.0 and share.get(0, 0.0) < 0.2


# licenses ------------------------------------------------------------------

def test_license_cases(spark):
    notice = license_scan.TEMPLATES[0][1]
    changed = notice.replace("person", "party").replace("any", "each")
    no_key = notice.replace("granted free", "granted, not free")
    texts = ["the MIT License, and mit-license", "CC  BY CC-BY", "GNU General\nPublic License v3", "Apache\u2003License",
             notice.upper(), changed, no_key, None, "", "mit license " * 20_000, "K\u212A cc by", "license mit", "mit lİcense"]
    rows = list(enumerate(texts)) + [(None, texts[0]), (0, texts[0])]
    got = {}
    for r in license_scan.license_digests(license_scan.scan_licenses(documents(spark, rows))).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert len(got[0]) == 2 and got[0][0] == got[0][1] and got[None][0][1:] == got[0][0][1:]
    got = {k: v[0] for k, v in got.items()}

    def of(i):
        r = got[i]
        return r.n_base, r.first_word, r.last_word, r.base_labels, r.labels
    assert of(0) == (2, 1, 4, "mit", "mit") and of(1) == (2, 0, 2, "cc-by", "cc-by") and of(2) == (1, 0, 0, "gpl", "gpl")
    assert of(3) == (0, None, None, "", "")                       # the space is a word character here
    assert of(4) == (0, None, None, "", "mit") and got[4].score == 1.0
    assert of(5) == (0, None, None, "", "mit") and 0.8 <= got[5].score < 1.0
    assert of(6) == (0, None, None, "", "") and got[6].score == 0.0
    assert of(7) == of(8) == (0, None, None, "", "") and got[7].n_words == 0
    assert of(9) == (20_000, 0, 39_998, "mit", "mit") and of(10) == (1, 1, 1, "cc-by", "cc-by")
    assert of(11) == of(12) == (0, None, None, "", "")
    assert license_scan.scan_licenses(documents(spark, []).limit(0)).count() == 0
