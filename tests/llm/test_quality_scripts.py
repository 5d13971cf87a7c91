"""Clean prose in other scripts passes the pipeline's quality stage."""

import re
import unicodedata

import corpus_pipeline
from sharecast.llm import quality_rules

from ..conftest import SF_SMALL
from . import brute


def test_prose_with_marks_of_other_scripts_stays(spark):
    lines = [" ".join(f"\u0915\u0916{14 * k + i}" for i in range(14)) for k in range(3)]
    marks = "\u0964\u0965\u061f\u060c\u061b\u06d4\u0589\u055e\u1362\u1363\u104b\u17d4\u0f0d\uff0c\uff01\uff1f\uff1a\uff1b\uff0e\U00011141"
    texts = ["\n".join(x + m for x in lines) for m in marks]
    bare = ["\n".join(x + m for x in lines) for m in ("", "\u1361", "\u0f0b", "-", "\u0903")]
    latin = ["\n".join(x + m for x in lines) for m in ".,\u2026\u3002"]
    docs = spark.createDataFrame([(i, t, "hi", "s", 1) for i, t in enumerate(texts + latin + bare)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.quality(spark, docs, SF_SMALL).collect()}
    assert got == dict(enumerate(texts + latin))
    for r in quality_rules.apply_quality_rules(docs).collect():
        assert (r.text, r.kept) == (brute.quality((texts + latin + bare)[r.doc_id])[0], r.doc_id < len(texts + latin))


def test_script_marks_are_punctuation():
    spans = re.findall(r"\\x\{(\w+)\}(?:-\\x\{(\w+)\})?", quality_rules.SCRIPT_MARKS)
    assert len(spans) > 50
    for a, b in spans:
        for c in range(int(a, 16), int(b or a, 16) + 1):
            assert unicodedata.category(chr(c)) == "Po", hex(c)


def test_page_furniture_of_four_languages_goes(spark):
    good = "A sentence, with marks and words enough to stand here as prose, one two three four five six seven eight."
    docs = spark.createDataFrame([(i, f"{good}\n{x[0].upper()}{x[1:]} © 2020\n{good} More.") for i, x in enumerate(quality_rules.BOILERPLATE)],
                                 "doc_id long, text string")
    assert {r.text for r in quality_rules.apply_quality_rules(docs).collect()} == {f"{good}\n{good} More."}
