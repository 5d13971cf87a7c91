"""License scan with a positional rare-token index.

The index holds, for every template, the word of its mandatory key phrase that is
rarest over all documents (highest IDF: fewest documents first) with its place. Every
match has that word in place, so a document looks up those words only and no match is
missed, whatever other words are changed; each hit proposes where the template would
start, its words are intersected by relative position, and a proposal stands if
``MIN_MATCH_PCT`` percent of the words are in place and the whole key phrase is. Base
phrases are templates of which every word is mandatory.

One pass counts the documents of each template word, a second judges every document
inside its row; nothing is shuffled but the counts, one per template word and task.
Distinct proposals are hashed, so a text that repeats a licence word thousands of
times costs its number of proposals times the length of a template.

Defined cases: a null or empty text has no words and no labels (empty strings, null
places, score 0); repeated rows are scanned alike, each on its own; of equal IDF the
alphabetically first word is taken; an empty table gives no rows; input columns
other than the id and the text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let, pick

MIN_MATCH_PCT = 80

# Base phrases with their labels.
BASE_PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# Well-known licence notices (label, notice in lower-case words,
# mandatory key phrase inside the notice).
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"
            " and associated documentation files",
     "hereby granted free of charge"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except"
               " in compliance with the license",
     "apache license version 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the"
            " gnu general public license as published by the free software foundation",
     "gnu general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the"
             " gnu lesser general public license as published by the free software foundation",
     "gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"
            " provided that the following conditions are met",
     "source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without"
            " fee is hereby granted",
     "with or without fee"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license",
     "mozilla public license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license",
     "creative commons attribution 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or"
            " neighboring rights to this work",
     "waived all copyright"),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     "unencumbered software released into the public domain"),
]

#: (label, words, how many must match, mandatory words of the template as a range)
def _index_rows(phrases=BASE_PHRASES, templates=TEMPLATES, min_pct: int = MIN_MATCH_PCT) -> list[tuple]:
    out = []
    for phrase, label in phrases:
        w = phrase.split()
        out.append((True, label, w, len(w), 0, len(w)))
    for label, notice, key in templates:
        w, k = notice.split(), key.split()
        at = next(i for i in range(len(w)) if w[i:i + len(k)] == k)
        out.append((False, label, w, -(-len(w) * min_pct // 100), at, at + len(k)))
    return out


def license_words(text: Column) -> Column:
    """Lower-cased words of a text. ``lower`` does what lower-casing A-Z does to these
    words but for two letters that it turns into ASCII ones (and it is much faster).
    Splitting at what is no word leaves an empty string at either end at most; it takes
    half the time of extracting the words."""
    t = F.coalesce(text, F.lit(""))
    low = F.when(F.contains(t, F.lit("\u0130")) | F.contains(t, F.lit("\u212A")), ascii_lower(t)).otherwise(F.lower(t))
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def template_word_counts(docs: DataFrame, text_col: str = "text", rows: list[tuple] | None = None) -> dict:
    """Documents that hold each mandatory word; the templates, a parameter, bound it."""
    vocabulary = sorted({w for r in rows or _index_rows() for w in r[2][r[4]:r[5]]})
    lit = F.array(*[F.lit(w) for w in vocabulary])
    got = (pick(docs, [text_col]).select(F.explode(F.array_intersect(license_words(F.col(text_col)), lit)).alias("w"))
           .groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect())
    return {w: 0 for w in vocabulary} | {r["w"]: r["n"] for r in got}


def rare_anchors(rows: list[tuple], counts: dict) -> list[tuple[str, int, int]]:
    """The posting (word, template, place) of each template's rarest mandatory word: all
    of these must be in place, so one place of one word finds every match."""
    out = []
    for t, (_, _, w, _, a, b) in enumerate(rows):
        j = min(range(a, b), key=lambda j: (counts[w[j]], w[j], j))
        out.append((w[j], t, j))
    return out


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  phrases=BASE_PHRASES, templates=TEMPLATES,
                  min_match_pct: int = MIN_MATCH_PCT) -> DataFrame:
    """All documents with what was found in them.

    Returns ``id_col``, ``n_words``, ``matches`` (array of template number, label, base
    or not, start word, words in place, words) and ``score`` (the largest share of words
    in place, 0 without a match)."""
    rows = _index_rows(phrases, templates, min_match_pct)
    postings = rare_anchors(rows, template_word_counts(docs, text_col, rows))
    by_word: dict[str, list] = {}
    for w, t, j in postings:
        by_word.setdefault(w, []).append((t, j))
    rare = sorted(by_word)
    shift = 1 << 20                       # offset that keeps negative starts in a code positive
    places = F.array(*[F.array(*[F.struct(F.lit(t).alias("t"), F.lit(j).alias("j")) for t, j in by_word[w]])
                       for w in rare])
    rare_lit = F.array(*[F.lit(w) for w in rare])
    notes = F.array(*[F.struct(
        F.lit(base).alias("base"), F.lit(label).alias("label"), F.array(*[F.lit(x) for x in w]).alias("w"),
        F.lit(need).alias("need"), F.lit(a).alias("a"), F.lit(b).alias("b")) for base, label, w, need, a, b in rows])

    def proposals(w: Column) -> Column:
        hits = F.filter(F.transform(w, lambda x, i: F.struct(i.alias("i"), x.alias("x"))),
                        lambda h: h["x"].isin(rare))
        return F.array_distinct(F.flatten(F.transform(hits, lambda h: F.transform(
            F.element_at(places, F.array_position(rare_lit, h["x"]).cast("int")),
            lambda p: (h["i"] - p["j"] + shift).cast("long") * len(rows) + p["t"]))))

    def judged(w: Column, code: Column) -> Column:
        start, t = F.floor(code / len(rows)).cast("int") - shift, (code % len(rows)).cast("int")
        return let(F.get(notes, t), lambda n: let(
            F.filter(F.sequence(F.lit(0), F.size(n["w"]) - 1),
                     lambda j: F.coalesce(F.get(w, start + j) == F.get(n["w"], j), F.lit(False))),
            lambda same: F.struct(
                t.alias("template"), n["label"].alias("label"), n["base"].alias("base"), start.alias("start"),
                F.size(same).alias("in_place"), F.size(n["w"]).alias("words"),
                ((F.size(same) >= n["need"]) & (F.size(F.filter(
                    same, lambda j: (j >= n["a"]) & (j < n["b"]))) == n["b"] - n["a"])).alias("ok"))))

    d = pick(docs, [id_col, text_col]).toDF("_id", "_text").select("_id", license_words(F.col("_text")).alias("_w"))
    none = F.array().cast("array<bigint>")
    d = d.select("_id", "_w", F.when(F.arrays_overlap("_w", rare_lit), proposals(F.col("_w")))
                 .otherwise(none).alias("_codes"))
    found = F.filter(F.transform("_codes", lambda c: judged(F.col("_w"), c)), lambda m: m["ok"])
    d = d.select("_id", F.size("_w").cast("long").alias("n_words"), found.alias("matches"))
    return d.select(F.col("_id").alias(id_col), "n_words", "matches", F.coalesce(F.array_max(F.transform(
        "matches", lambda m: m["in_place"] / m["words"])), F.lit(0.0)).alias("score"))


def license_digests(scanned: DataFrame) -> DataFrame:
    def labels(m: Column) -> Column:
        return F.array_join(F.sort_array(F.array_distinct(F.transform(m, lambda x: x["label"]))), ",")

    base = scanned.select("*", F.filter("matches", lambda m: m["base"]).alias("base"))
    return base.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda m: m["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda m: m["start"])).cast("long").alias("last_word"),
        labels(F.col("base")).alias("base_labels"), labels(F.col("matches")).alias("labels"), "score")
