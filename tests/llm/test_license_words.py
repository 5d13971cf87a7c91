"""Words of the license scan."""

import re

from sharecast.llm import license_scan


def test_license_words_by_splitting(spark):
    texts = [None, "", "   ", "Mit-License 2.0", "İstanbul Kelvin", "é x ÄÖ", "\nA\tb\x00C{d}", "..", "ends.", "🙂a b🙂"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = rows.select("i", license_scan.license_words(rows["t"]).alias("w"))
    lowered = ["".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in t or "") for t in texts]
    got = {r.i: r.w for r in out.collect()}
    for i, t in enumerate(lowered):
        want = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
        assert [w.lower() for w in got[i]] == [w.lower() for w in want]
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "regexp_extract_all" not in plan and "rlike" not in plan
