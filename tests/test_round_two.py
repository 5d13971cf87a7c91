"""Cases the first review found: hot unseen keys, pairing by source, headers, failing
writes, page records, staged tables, changed data."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from sharecast.functions import text as TX
from sharecast.operators import explore as X
from sharecast.operators import joins as J
from sharecast.plans import queries as Q
from sharecast.sources import articles as A
from sharecast.sources import files as FS
from sharecast.sources import shares as SH

from .conftest import SF_SMALL


def test_a_frequent_value_without_entry_spreads_over_reducers(spark):
    fact = spark.range(6000).select(F.col("id").alias("article_id"), F.when(F.col("id") % 3 == 0, F.lit("unseen"))
                                    .when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.concat(F.lit("v"), F.col("id") % 50)).alias("k"))
    dim = spark.range(40).select(F.concat(F.lit("v"), F.col("id")).alias("k"), F.col("id").alias("v"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = J.lookup_join(fact, dim, ["k"], how="left", broadcast_rows=0, max_hot_keys=8, salts=8, salt_source="article_id")
        where = out.filter("k = 'unseen'").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert out.count() == 6000 and out.filter("v is not null").count() == fact.join(dim, "k").count()
    assert len(where) >= 3 and max(r["count"] for r in where) < 1500


def test_a_wide_dimension_is_not_broadcast(spark):
    fact = spark.createDataFrame([(1, "a")], "article_id long, k string")
    dim = spark.createDataFrame([("a", "x" * 2000)], "k string, v string")
    small = J.lookup_join(fact, dim, ["k"])
    wide = J.lookup_join(fact, dim, ["k"], broadcast_bytes=1000)
    assert [r.v for r in small.collect()] == [r.v for r in wide.collect()]
    assert "ResolvedHint" in small._jdf.queryExecution().analyzed().toString()
    assert "_salt" in wide._jdf.queryExecution().analyzed().toString()


def test_networks_are_paired_within_a_source(spark):
    rows = [(7, s, n, 10 * s + i, 1) for s in (1, 2) for i, n in enumerate(("click", "view"))]
    totals = spark.createDataFrame(rows, "article_id long, source long, network string, shares long, n_replies long")
    got = sorted(map(tuple, X.paired_networks(totals, "click", "view").select(
        "article_id", "source", "click_shares", "view_shares").collect()))
    assert got == [(7, 1, 10, 11), (7, 2, 20, 21)]


def test_replies_of_all_networks_are_read(spark):
    all_types = spark.read.parquet(f"{SF_SMALL}/events.parquet").count()
    assert SH.share_replies(spark, SF_SMALL).count() == all_types
    assert 0 < SH.share_replies(spark, SF_SMALL, SH.NETWORKS).count() < all_types


def test_header_comes_from_the_first_file_by_path(spark, tmp_path):
    (tmp_path / "part-0.txt").write_text("url, timedelta, f0, shares\nu0, 1.0, x, 9\n")
    (tmp_path / "part-1.txt").write_text("".join(f"u{i}, 3.0, y, 10\n" for i in range(2, 500)))
    path = f"file://{tmp_path}"
    assert FS.first_line(spark, path) == "url, timedelta, f0, shares"
    arts = A.articles_from_file(spark, path)
    assert arts.count() == 499 and {"url", "timedelta", "f0", "shares", "article_id"} == set(arts.columns)
    ids = {r.url: r.article_id for r in arts.collect()}
    again = {r.url: r.article_id for r in A.articles_from_file(spark, path).repartition(5).collect()}
    assert ids == again and len(set(ids.values())) == 499


def test_a_failing_bucketed_write_fails_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def fail(batches):
        seen.add(1)
        raise RuntimeError("no such row")
        yield from batches

    df = spark.range(4, numPartitions=1).mapInPandas(fail, "id long")
    with pytest.raises(Exception, match="no such row"):
        FS.write_bucketed(df, "broken", "id")


def test_page_records_golden(spark):
    def page(record, tag="script"):
        return f"<html><{tag} type='a'>window.meta = {record}; go();</{tag}><script>x = 1;</script></html>"

    cases = {
        1: (page('{"age": "2", "channel": "tech"}', "SCRIPT"), {"age": "2", "channel": "tech"}),
        2: (page("{age: 2, channel: 'tech'}"), {"age": "2", "channel": "tech"}),
        3: (page("{age: 2, channel: world news}"), {"age": "2", "channel": "world news"}),
        4: (page("\n    age: 2\n    channel: \"tech\"\n    age: 3\n"), {"age": "3", "channel": "tech"}),
        5: (page('"</p>"'), None),
        6: (page("[1, 2]"), None),
        7: ("<p>none</p>", None),
        8: (None, None),
    }
    pages = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "page_id long, html string")
    got = X.page_records(pages).withColumn("m", TX.record_map("record_text")).collect()
    for r in got:
        assert r.m == cases[r.page_id][1], (r.page_id, r.record_text, r.m)
        assert r.is_mapping == (cases[r.page_id][1] is not None)


def test_common_indent_is_removed_and_nesting_stays(spark):
    import textwrap

    texts = ["  a:\n    b: 1\n  c: 2", "\tx\n\t\ty", "  x\n\ty", "a\n  b", "", "   ", "  a\n\n   \n  b", "    deep"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    for r in df.select("t", TX.strip_indent("t").alias("d")).collect():
        assert r.d == textwrap.dedent(r.t), (r.t, r.d)


def test_staged_tables_are_deleted_on_release(spark):
    kept = list(FS._staged)
    FS._staged.clear()
    try:
        df, path = FS.pin_table(spark.range(5), "t", with_path=True)
        bucketed = FS.write_bucketed(spark.range(5), "b", "id", rows=5)
        name = [t for _, _, t in FS._staged if t][0]
        assert df.count() == bucketed.count() == 5 and spark.catalog.tableExists(name)
        assert FS.release_staged(spark) == 2
        assert not spark.catalog.tableExists(name) and not os.path.exists(path.replace("file:", ""))
    finally:
        FS._staged.extend(kept)


def test_changed_data_is_prepared_anew(spark, tmp_path):
    sf = str(tmp_path / "sf")
    shutil.copytree(SF_SMALL, sf)
    first = Q._key(spark, "prep", sf)
    assert first == Q._key(spark, "prep", sf)
    os.utime(os.path.join(sf, "orders.parquet"), (1, 1))
    assert first != Q._key(spark, "prep", sf)


def test_fifty_steps_run_before_the_stopping_rule(spark):
    """The oracle unrolls all 50 steps; that is what the fits do on these tables."""
    assert {m.iterations_run for m in Q._fits(spark, SF_SMALL)} == {Q.FULL_ITERATIONS}


def test_buckets_grow_with_the_rows(spark):
    base = FS.bucket_count(spark)
    assert FS.bucket_count(spark, 10) == base
    assert FS.bucket_count(spark, 1000 * FS.ROWS_PER_BUCKET) == 1000
