"""Line-first quality rules.

Each line is judged by three rules, failing lines are removed, and a document that
loses more than ``MAX_LOST_PCT`` percent of its word characters is rejected:

* punctuation: more than one decorative symbol per two words, or more than three
  exclamation marks per ten words, or at least ``BARE_WORDS`` words without any
  punctuation mark;
* navigation: at least three separators (``|`` and the like), more than one per
  five words;
* boilerplate: a line of at most ``BOILERPLATE_WORDS`` words with a fixed phrase.

Base measures are taken of the whole text before that; a document also fails with
fewer than ``MIN_WORDS`` words or with more than ``MAX_REPEAT_PCT`` percent of its
words in 8-word windows that occur twice or more. Every measure is computed inside
the row with built-in functions, so there is no shuffle and no group of documents.
Windows are compared by 64-bit hashes; only texts in which some hash repeats pay
for the sort that finds the covered words, so a long text costs O(n log n).

Defined cases: a null or empty text has no words and fails; a document without word
characters loses nothing; repeated rows are judged alike, each on its own; an empty
table gives no rows; input columns other than the id, the text and ``keep`` are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_CLASS, let, pick, words

MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PCT = 30
MAX_LOST_PCT = 50
BARE_WORDS = 12
BOILERPLATE_WORDS = 15

# Phrases of page furniture (English, French, German, Spanish).
BOILERPLATE = [
    "all rights reserved", "click here", "cookie policy", "enable javascript", "lorem ipsum",
    "privacy policy", "sign in to continue", "subscribe to our newsletter", "terms of use",
    "tous droits réservés", "cliquez ici", "politique de confidentialité", "mentions légales",
    "alle rechte vorbehalten", "hier klicken", "datenschutzerklärung", "allgemeine geschäftsbedingungen",
    "todos los derechos reservados", "haga clic aquí", "política de privacidad", "aviso legal",
]

#: Sentence and clause marks beyond the fixed Latin and CJK ones, by code point (Unicode's
#: terminal punctuation without word dividers, and the Armenian and vertical marks).
SCRIPT_MARKS = "".join("-".join(f"\\x{{{x}}}" for x in span.split("-")) for span in (
    "037E 0387 055B-055E 0589 05C3 060C 061B 061D-061F 06D4 0700-070A 070C 07F8-07F9 0837 0839 083D-083E "
    "085E 0964-0965 0E5A-0E5B 0F08 0F0D-0F12 104A-104B 1362-1368 166E 1735-1736 17D4-17D6 17DA 1802-1805 "
    "1808-1809 1944-1945 1AA8-1AAB 1B5A-1B5B 1B5D-1B5F 1C3B-1C3F 1C7E-1C7F 203C-203D 2047-2049 2CF9-2CFB "
    "2E2E 2E32 2E35 2E3C 2E41 A4FE-A4FF A60D-A60F A6F3-A6F7 A876-A877 A8CE-A8CF A92F A9C7-A9C9 AA5D-AA5F "
    "AAF0-AAF1 ABEB FE10-FE16 FE19 FE50-FE52 FE54-FE57 FF01 FF0C FF0E FF1A-FF1B FF1F FF61 FF64 "
    "11047-1104D 110BE-110C1 11141-11143 111C5-111C6 11238-1123C 1144B-1144D 1145A-1145B 115C2-115C5 "
    "11641-11642 1173C-1173E 11C41-11C43 16B37-16B39").split())


def any_phrase(phrases: list[str]) -> str:
    """A pattern of the phrases, by first letter, so that few branches are tried per place."""
    heads: dict[str, list[str]] = {}
    for x in phrases:
        heads.setdefault(x[0], []).append(x[1:])
    return "|".join(f"{a}(?:{'|'.join(rest)})" for a, rest in heads.items())


def chars_of(c: Column, chars: str) -> Column:
    """How many characters of ``c`` are in the regex class body ``chars``."""
    return F.length(F.regexp_replace(c, f"[^{chars}]+", ""))


def word_chars(c: Column) -> Column:
    return F.length(F.regexp_replace(c, f"[{WS_CLASS}]+", ""))


def repeated_window_words(w: Column, n: int = WINDOW) -> Column:
    """How many entries of the array ``w`` lie in ``n``-entry windows that occur twice
    or more in it."""
    def covered(hashes: Column) -> Column:
        order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(order, lambda s: F.sort_array(F.transform(
            F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False))
                     | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))),
            lambda x: x["i"])))
        return let(twice, lambda p: F.aggregate(
            F.transform(p, lambda x, j: F.least(F.lit(n), F.coalesce(F.get(p, j + 1) - x, F.lit(n)))),
            F.lit(0), lambda a, x: a + x))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - n),
                           lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))

    repeated = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: let(
        windows(h), lambda v: F.when(F.size(F.array_distinct(v)) < F.size(v), covered(v)).otherwise(0)))
    return F.when(F.size(w) > n, repeated).otherwise(0)


def line_fails(line: Column) -> Column:
    """True for a line that a punctuation, navigation or boilerplate rule removes."""
    n = F.size(F.split(F.regexp_replace(line, f"^[{WS_CLASS}]+", ""), f"[{WS_CLASS}]+"))
    symbols, bangs, bars = chars_of(line, r"#*$%&<>"), chars_of(line, "!"), chars_of(line, "|»›•")
    bare = (n >= BARE_WORDS) & ~F.rlike(line, F.lit(r'[.,;:!?"…。、]')) & ~F.rlike(line, F.lit(f"[{SCRIPT_MARKS}]"))
    punctuation = (symbols * 2 > n) | ((n >= 5) & (bangs * 10 > n * 3)) | bare
    navigation = (bars >= 3) & (bars * 5 > n)
    boilerplate = (n <= BOILERPLATE_WORDS) & F.rlike(F.lower(line), F.lit(any_phrase(BOILERPLATE)))
    return F.rlike(line, F.lit(f"[^{WS_CLASS}]")) & (punctuation | navigation | boilerplate)


def apply_quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                        keep: tuple[str, ...] = ()) -> DataFrame:
    """All documents with their measures and verdict.

    Returns ``id_col``, the columns of ``keep``, ``text_col`` (cleaned: lines that
    failed are gone), ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``lost_chars``, ``base_failed`` and ``kept``."""
    d = pick(docs, [id_col, text_col, *keep]).toDF("_id", "_text", *keep)
    d = d.withColumn("_text", F.coalesce("_text", F.lit("")))
    d = d.select("*", words(F.col("_text")).alias("_w"), F.split("_text", "\n", -1).alias("_lines"))
    real = F.filter("_lines", lambda x: F.rlike(x, F.lit(f"[^{WS_CLASS}]")))
    d = d.select(
        "_id", *keep, "_text",
        F.size("_w").alias("_n"), word_chars(F.col("_text")).alias("_chars"),
        chars_of(F.col("_text"), r"#*$%&|<>").alias("_symbols"),
        let(real, lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("_dups"),
        repeated_window_words(F.col("_w")).alias("_repeats"),
        F.array_join(F.filter("_lines", lambda x: ~line_fails(x)), "\n").alias("_clean"))
    d = d.withColumn("_lost", F.col("_chars") - word_chars(F.col("_clean")))
    failed = (F.col("_n") < MIN_WORDS) | (100 * F.col("_repeats") > MAX_REPEAT_PCT * F.col("_n"))
    judged = F.struct(
        F.col("_id").alias(id_col), *keep, F.col("_clean").alias(text_col),
        F.col("_n").cast("long").alias("n_words"), F.col("_chars").cast("long").alias("word_chars"),
        F.col("_symbols").cast("long").alias("n_symbols"), F.col("_dups").cast("long").alias("n_dup_lines"),
        F.col("_repeats").cast("long").alias("n_repeat_words"),
        F.col("_lost").cast("long").alias("lost_chars"), failed.alias("base_failed"),
        (~failed & (100 * F.col("_lost") <= MAX_LOST_PCT * F.col("_chars"))).alias("kept"))
    # a generator of one row: a caller's filter on the verdict stays above it, instead of
    # moving down and making Spark clean every text a second time
    return d.select(F.inline(F.array(judged)))
