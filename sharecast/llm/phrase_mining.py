"""Phrase collocation mining: the best scoring phrases of every language, by best-first
branch-and-bound growth.

A phrase of 2 to ``MAX_WORDS`` words is a candidate if it occurs at least ``min_count``
times inside pieces of texts. Cut after its first k words it scores a * n / (l * r); the
lowest cut counts. All extensions of a prefix p score at most n / f(w) for p's first
word w (the cut after w: l = f(w), and the rest r occurs at least as often as the
phrase), so w's count bounds its whole branch. Branches grow best bound first, a batch of
first words at a time: the rarest words that cover an eighth of a language's frequent
words, then, with S the score of the ``top``-th survivor so far, every branch whose bound
reaches S (ties included). With fewer survivors the batch covers half, then all. No
branch left unexpanded can hold a phrase of the result.

One pass over the texts writes them as word codes (a chunk of texts is a local dictionary
and indices into it) beside the word counts. Growth by a word is a pass over these chunks:
tasks count the extensions of prefixes known to be frequent (apriori) with numpy,
a row per phrase and flush goes to the shuffle, and sums of at least ``min_count`` make
the next level. Which prefixes to extend, which words are frequent and which phrases are
wanted tasks learn from bit filters of at most ``FILTER_WORDS`` words; what a filter lets
through wrongly is counted and then dropped by an exact join, so filters change costs
only. One more pass counts the candidates with their neighbours, and the rests of their
cuts, which may begin with words that are not expanded.

A candidate inside a longer one of the same count is dropped. That is so exactly if all
its occurrences have the same word before them, or all the same word behind them, within
their pieces; the candidate's own count shows it, in whatever branch the longer one is.

Defined cases: a null text is empty, a null language is ``und``; a word is any run of
characters but blanks and piece ends, however long; copies and repeated rows all count;
equal scores are ordered by count, then by the phrase's bytes; a language without
candidates, or an empty table, gives no rows; other columns are ignored. Word codes are
64-bit hashes, checked to be unique among all words (else drawn again); phrases are
told apart by the 64-bit code of their first part and that of their last word.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import lookup_join
from ..sources.files import drop_files, pin_table
from .common import broadcast_if_small, pick, ship_package
from .text_hash import C1, mix

MAX_WORDS = 5
MIN_COUNT = 100
TOP = 2000
#: Parts of a language's frequent words that the first batches of branches cover.
SHARES = (0.125, 0.5, 1.0)
CHUNK_BYTES = 1 << 20
FLUSH = 1_000_000           # phrase occurrences aggregated at once in a task
VOCABULARY = 150_000        # words counted at once in a task
WORD_ROWS = 50_000          # words given to Spark at once
FILTER_WORDS = 1 << 20      # 64-bit words of a filter at most (8 MB); a power of two
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
CLASSES = np.array([2 if b in PIECE_ENDS else 1 if b in b" \t" else 0 for b in range(256)], np.uint8)


def extend(prefix: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Codes of phrases from the codes of their first parts and last words."""
    return mix(prefix * C1 + last)


# texts to word codes ----------------------------------------------------------

def _words(texts: list[bytes]):
    """All words of the texts (an Arrow array), their text's number, and whether each
    begins a piece."""
    import pyarrow as pa

    data = np.frombuffer(b"\n" + b"\n".join(texts).lower() + b"\n", np.uint8)
    kind = CLASSES[data]
    inside = kind == 0
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    passed = np.cumsum(kind == 2, dtype=np.int64)[starts]
    new = np.concatenate((np.ones(min(len(starts), 1), bool), passed[1:] != passed[:-1]))
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    words = pa.Array.from_buffers(pa.large_binary(), len(starts),
                                  [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    first = np.cumsum([1] + [len(t) + 1 for t in texts])
    return words, np.searchsorted(first, starts, "right") - 1, new


def encode_chunk(langs: list[str], texts: list[bytes], seed: int):
    """(codes, ids, vocabulary): ids of all words into codes, 0 (code 0) before each piece;
    the vocabulary is [(lang, word, count)] in the order of codes from 1 on."""
    import xxhash

    words, text, new = _words(texts)
    coded = words.dictionary_encode()
    known = sorted(set(langs))
    lang = np.array([known.index(x) for x in langs], np.int64)[text]
    pair = coded.indices.to_numpy().astype(np.int64) * len(known) + lang
    kinds, ids, counts = np.unique(pair, return_inverse=True, return_counts=True)
    spelled = coded.dictionary.to_pylist()
    seeds = [xxhash.xxh64_intdigest(x.encode(), seed) for x in known]
    vocabulary = [(known[k % len(known)], spelled[k // len(known)], n)
                  for k, n in zip(kinds.tolist(), counts.tolist(), strict=True)]
    codes = np.array([0] + [xxhash.xxh64_intdigest(spelled[k // len(known)], seeds[k % len(known)]) or 1
                            for k in kinds.tolist()], np.uint64)
    out = np.zeros(len(ids) + int(new.sum()), np.uint16 if len(codes) <= 1 << 16 else np.uint32)
    out[np.arange(len(ids)) + np.cumsum(new)] = ids + 1
    return codes, out, vocabulary


def _encode(seed: int):
    """(lang, text) rows to chunks (codes, ids) and to words (lang, word, code, n)."""
    import pyarrow as pa

    def chunk_row(codes, ids):
        return pa.RecordBatch.from_arrays(
            [pa.array([codes.tobytes()], pa.binary()), pa.array([ids.tobytes()], pa.binary()),
             pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())],
            ["codes", "ids", "lang", "word", "code", "n"])

    def word_rows(counted):
        for b in counted.to_batches(max_chunksize=WORD_ROWS):
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(b), pa.binary()), pa.nulls(len(b), pa.binary()),
                 *(b.column(c) for c in ("lang", "word", "code", "n"))], ["codes", "ids", "lang", "word", "code", "n"])

    def merged(held):
        added = pa.concat_tables(held).group_by(["lang", "word", "code"], use_threads=False).aggregate([("n", "sum")])
        return added.select(["lang", "word", "code", "n_sum"]).rename_columns(["lang", "word", "code", "n"])

    def run(batches):
        # words as Arrow columns: as Python objects they would take ten times the memory
        held, rows = [], 0
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).cast("binary").to_pylist()
            lo, size = 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size < CHUNK_BYTES and i + 1 < len(texts):
                    continue
                codes, ids, vocabulary = encode_chunk(langs[lo:i + 1], texts[lo:i + 1], seed)
                lo, size = i + 1, 0
                if len(ids):
                    yield chunk_row(codes, ids)
                if vocabulary:
                    lang, word, n = zip(*vocabulary, strict=True)
                    held.append(pa.table({"lang": pa.array(lang, pa.string()), "word": pa.array(word, pa.binary()).cast(pa.string()),
                                          "code": codes[1:].view(np.int64).copy(), "n": pa.array(n, pa.int64())}))
                    rows += len(word)
                    del codes, ids, vocabulary, lang, word, n
                if rows >= 2 * VOCABULARY:
                    held = [merged(held)]
                    rows = held[0].num_rows
                    if rows >= VOCABULARY:
                        yield from word_rows(held.pop())
                        rows = 0
        if held:
            yield from word_rows(merged(held))

    return run


# filters ------------------------------------------------------------------------

def bit_filter(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of the column ``h`` (three bits of one word a key), built and merged
    by tasks. It has 16 bits a key up to FILTER_WORDS words; beyond, it lets more through."""
    n = keys.count()
    words = 1 << min(max(n * 16 // 64, 1 << 8).bit_length(), FILTER_WORDS.bit_length() - 1)
    mask = F.lit(0).cast("long")
    for k in range(3):
        at = F.shiftrightunsigned("h", 6 * k).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), at))
    made = (keys.select(F.shiftrightunsigned("h", 65 - words.bit_length()).alias("w"), mask.alias("m"))
            .groupBy("w").agg(F.bit_or("m").alias("m")).toArrow())
    bits = np.zeros(words, np.uint64)
    bits[made["w"].to_numpy()] = made["m"].to_numpy().view(np.uint64)
    return bits


def probe(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    one, low = np.uint64(1), np.uint64(63)
    mask = (one << (h & low)) | (one << ((h >> np.uint64(6)) & low)) | (one << ((h >> np.uint64(12)) & low))
    return bits[(h >> np.uint64(65 - len(bits).bit_length())).astype(np.int64)] & mask == mask


# passes over the chunks ------------------------------------------------------------

class _Counter:
    """Phrase occurrences (length, first part, last word, neighbours) held up to FLUSH,
    then aggregated: a neighbour that all share, else 0."""

    names = ["len", "prefix", "last", "n", "left", "right"]

    def __init__(self):
        self.held, self.size = [], 0

    def add(self, length, prefix, last, left, right):
        if len(prefix):
            self.held.append((np.full(len(prefix), length, np.int8), prefix, last, left, right))
            self.size += len(prefix)
        if self.size >= FLUSH:
            yield self.flush()

    def flush(self):
        import pyarrow as pa

        columns, self.held, self.size = [list(x) for x in zip(*self.held, strict=True)], [], 0
        for i, parts in enumerate(columns):      # a column at a time: its parts go as it is made
            columns[i] = np.concatenate(parts)
            parts.clear()
        order = np.argsort(extend(columns[1], columns[2]))
        for i, x in enumerate(columns):
            columns[i] = x[order]
        del order, x
        length, prefix, last, left, right = columns
        new = np.concatenate(([True], (prefix[1:] != prefix[:-1]) | (last[1:] != last[:-1]) | (length[1:] != length[:-1])))
        at = np.flatnonzero(new)
        both = [np.where(np.minimum.reduceat(x, at) == np.maximum.reduceat(x, at), x[at], 0) for x in (left, right)]
        return pa.RecordBatch.from_arrays(
            [pa.array(length[at].astype(np.int32)), *[pa.array(x.view(np.int64)) for x in (prefix[at], last[at])],
             pa.array(np.diff(np.concatenate((at, [len(prefix)])))), *[pa.array(x.view(np.int64)) for x in both]], self.names)


def _each_chunk(batches):
    for b in batches:
        for codes, ids in zip(b.column(0), b.column(1), strict=True):
            local = np.frombuffer(codes.as_buffer(), np.uint64)
            index = np.frombuffer(ids.as_buffer(), np.uint16 if len(local) <= 1 << 16 else np.uint32)
            yield local, np.concatenate((index, np.zeros(MAX_WORDS + 1, index.dtype)))


def _grow(length: int, alive, frequent):
    """Count the phrases of ``length`` words whose shorter first parts are alive and whose
    words are frequent."""

    def run(batches):
        counter = _Counter()
        for local, ids in _each_chunk(batches):
            codes = local[ids]
            usual = probe(frequent.value, local)
            usual[0] = False
            opens, usual = (probe(alive.value, local) & usual)[ids], usual[ids]
            at = np.flatnonzero(opens[:-1] & usual[1:])
            first = codes[at]
            for k in range(1, length - 1):
                first = extend(first, codes[at + k])
                go = probe(alive.value, first) & usual[at + k + 1]
                at, first = at[go], first[go]
            zero = np.zeros(len(at), np.uint64)
            yield from counter.add(length, first, codes[at + length - 1], zero, zero)
        if counter.size:
            yield counter.flush()

    return run


def _count_wanted(max_words: int, alive, wanted):
    """Count all wanted phrases, with the neighbours that their occurrences share."""

    def run(batches):
        counter = _Counter()
        for local, ids in _each_chunk(batches):
            codes = local[ids]
            begins = probe(alive.value, local)
            begins[0] = False
            at = np.flatnonzero(begins[ids])
            first = codes[at]
            for k in range(1, max_words):
                go = codes[at + k] != 0
                at, first = at[go], first[go]
                last = codes[at + k]
                whole = extend(first, last)
                hit = probe(wanted.value, whole)
                yield from counter.add(k + 1, first[hit], last[hit], codes[at[hit] - 1], codes[at[hit] + k + 1])
                go = probe(alive.value, whole)
                at, first = at[go], whole[go]
        if counter.size:
            yield counter.flush()

    return run


def _with_code(batches):
    """Adds ``h``, the phrase's code."""
    import pyarrow as pa

    for b in batches:
        prefix, last = (b.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(extend(prefix, last).view(np.int64))], ["prefix", "last", "n", "h"])


def _parts(batches):
    """Phrases (column ``codes``) to the codes of what must be counted, and of its first
    parts: (h, wanted)."""
    import pyarrow as pa

    for b in batches:
        wanted, alive = set(), set()
        for codes in b.column(0).to_pylist():
            codes = np.array(codes, np.int64).view(np.uint64)
            for k in range(len(codes) - 1):
                h = codes[k:k + 1]
                for c in range(k + 1, len(codes)):
                    alive.add(int(h[0]))
                    h = extend(h, codes[c:c + 1])
                wanted.add(int(h[0]))
        h = np.array([*wanted, *alive], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.arange(len(h)) < len(wanted))], ["h", "wanted"])


def _cuts(batches):
    """A row per phrase and cut k (0: the phrase itself): the length, first part and last
    word of what follows the cut, and the count of what precedes it."""
    import pyarrow as pa

    for b in batches:
        out = []
        for lang, codes, counts, a in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            u = np.array(codes, np.int64).view(np.uint64)
            for k in range(len(codes)):
                h = u[k:k + 1]
                for c in range(k + 1, len(codes) - 1):
                    h = extend(h, u[c:c + 1])
                first = int(h.view(np.int64)[0]) if k < len(codes) - 1 else 0
                out.append((lang, codes, a, k, counts[k - 1] if k else a, len(codes) - k, first, codes[-1]))
        kinds = [pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        columns = zip(*out, strict=True) if out else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, kinds, strict=True)],
                                         ["lang", "codes", "a", "k", "l", "len", "prefix", "last"])


# the search --------------------------------------------------------------------------

COUNTS = "len int, prefix bigint, last bigint, n bigint, left bigint, right bigint"


class _Corpus:
    """The chunks, the frequent words and the sizes of the languages."""

    def __init__(self, docs: DataFrame, lang_col: str, text_col: str, min_count: int, max_words: int):
        self.spark, self.min_count, self.max_words = docs.sparkSession, min_count, max_words
        ship_package(self.spark)
        d = pick(docs, [lang_col, text_col]).toDF("lang", "text").select(
            F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
        seed = 0
        while True:
            made, path = pin_table(d.mapInArrow(_encode(seed), "codes binary, ids binary, lang string, word string, code bigint, n bigint"),
                                   "phrase-chunks", with_path=True)
            words = pin_table(made.filter("lang is not null").groupBy("lang", "word", "code").agg(F.sum("n").alias("n")), "phrase-words")
            if not words.groupBy("code").count().filter("count > 1").limit(1).count():
                break
            drop_files(self.spark, path)
            seed += 1
        self.chunks = made.filter("codes is not null").select("codes", "ids")
        self.totals = pin_table(words.groupBy("lang").agg(F.sum("n").alias("total")), "phrase-totals")
        self.words = pin_table(words.filter(F.col("n") >= min_count), "phrase-frequent")
        self.frequent = self.spark.sparkContext.broadcast(bit_filter(self.words.select(F.col("code").alias("h"))))

    def scan(self, run, schema: str) -> DataFrame:
        return self.chunks.mapInArrow(run, schema)

    def branches(self, first: DataFrame) -> DataFrame:
        """All frequent phrases that begin with the words ``first``: lang, codes, counts
        (of their proper first parts), prefix, last, h, n."""
        level = pin_table(first.select("lang", F.array("code").alias("codes"), F.array().cast("array<bigint>").alias("counts"),
                                       F.col("code").alias("h"), "n"), "phrase-level")
        alive, found = bit_filter(level.select("h")), []
        for length in range(2, self.max_words + 1):
            shared = self.spark.sparkContext.broadcast(alive)
            grown = (self.scan(_grow(length, shared, self.frequent), COUNTS).groupBy("prefix", "last")
                     .agg(F.sum("n").alias("n")).filter(F.col("n") >= self.min_count)
                     .mapInArrow(_with_code, "prefix bigint, last bigint, n bigint, h bigint"))
            before = level.select("lang", "codes", "counts", F.col("h").alias("prefix"), F.col("n").alias("_n"))
            level = pin_table(lookup_join(grown, before, ["prefix"]).select(
                "lang", F.concat("codes", F.array("last")).alias("codes"), F.concat("counts", F.array("_n")).alias("counts"),
                "prefix", "last", "h", "n"), "phrase-level")
            shared.destroy()
            found.append(level)
            if length < self.max_words:
                alive = _joined(alive, bit_filter(level.select("h")))
        out = found[0]
        for x in found[1:]:
            out = out.unionByName(x)
        return out

    def scored(self, phrases: DataFrame) -> DataFrame:
        """The phrases that stay, with the count, scores and parts of their lowest cut:
        lang, codes, a, l, r, n, score."""
        parts = pin_table(phrases.select("codes").mapInArrow(_parts, "h bigint, wanted boolean"), "phrase-parts")
        alive = self.spark.sparkContext.broadcast(bit_filter(parts.filter("not wanted").select("h")))
        wanted = self.spark.sparkContext.broadcast(bit_filter(parts.filter("wanted").select("h")))
        counted = (self.scan(_count_wanted(self.max_words, alive, wanted), COUNTS).groupBy("len", "prefix", "last")
                   .agg(F.sum("n").alias("r"), F.min("left").alias("_l0"), F.max("left").alias("_l1"),
                        F.min("right").alias("_r0"), F.max("right").alias("_r1")))
        one_side = ((F.col("_l0") == F.col("_l1")) & (F.col("_l0") != 0)) | ((F.col("_r0") == F.col("_r1")) & (F.col("_r0") != 0))
        counted = counted.select("len", "prefix", "last", "r", one_side.alias("inside"))
        single = self.words.select(F.lit(1).alias("len"), F.lit(0).cast("long").alias("prefix"), F.col("code").alias("last"),
                                   F.col("n").alias("r"), F.lit(False).alias("inside"))
        counted = pin_table(counted.unionByName(single), "phrase-counts")
        alive.destroy()
        wanted.destroy()
        cuts = pin_table(phrases.select("lang", "codes", "counts", "n").mapInArrow(
            _cuts, "lang string, codes array<bigint>, a bigint, k int, l bigint, len int, prefix bigint, last bigint"), "phrase-cuts")
        big = "cast({} as decimal(38,0))".format
        score = F.expr(f"{big(1000)} * cast(a as decimal(19,0)) * cast(total as decimal(16,0)) div ({big('l')} * cast(r as decimal(19,0)))")
        rows = (lookup_join(cuts, counted, ["len", "prefix", "last"]).join(broadcast_if_small(self.totals), "lang")
                .withColumn("_s", F.when(F.col("k") > 0, score * 8 + F.col("k"))))
        best = rows.groupBy("lang", "codes", "a", "total").agg(
            F.min("_s").alias("_s"), F.min_by("l", "_s").alias("l"), F.min_by("r", "_s").alias("r"),
            F.bool_or((F.col("k") == 0) & F.col("inside")).alias("inside"))
        return best.filter(~F.col("inside") | (F.size("codes") == self.max_words)).select(
            "lang", "codes", "a", "l", "r", F.col("total").alias("n"), F.expr("_s div 8").alias("score"))


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A filter with the keys of both (a shorter one is spread to the longer's words)."""
    if len(a) < len(b):
        a, b = b, a
    return a | np.repeat(b, len(a) // len(b))


def _batch(corpus: _Corpus, share: float) -> DataFrame:
    """Per language the greatest count of a first word (of an eighth of a power of two)
    such that the words up to it cover ``share`` of all frequent ones."""
    step = F.floor(F.log2("n") * 8)
    spread = corpus.words.groupBy("lang", step.alias("step")).agg(F.sum("n").alias("mass"))
    upto, all_of = Window.partitionBy("lang").orderBy("step"), Window.partitionBy("lang")
    return (spread.withColumn("upto", F.sum("mass").over(upto)).withColumn("all", F.sum("mass").over(all_of))
            .withColumn("least", F.min("step").over(all_of))
            .filter((F.col("upto") <= F.lit(share) * F.col("all")) | (F.col("step") == F.col("least")))
            .groupBy("lang").agg(F.max("step").alias("step")))


def mine_phrases(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", top: int = TOP,
                 min_count: int = MIN_COUNT, max_words: int = MAX_WORDS) -> DataFrame:
    """Per language its first ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    if not 2 <= max_words <= MAX_WORDS:
        raise ValueError(f"phrases have 2 to {MAX_WORDS} words")
    corpus = _Corpus(docs, lang_col, text_col, min_count, max_words)
    step = F.floor(F.log2("n") * 8)
    bounded = corpus.words.join(broadcast_if_small(corpus.totals), "lang").withColumn(
        "bound", F.expr("cast(1000 as decimal(38,0)) * cast(total as decimal(19,0)) div cast(n as decimal(19,0))"))
    opened = found = settled = None
    for share in SHARES:
        limits = _batch(corpus, share).withColumnRenamed("step", "_step")
        first = bounded.join(broadcast_if_small(limits), "lang")
        if settled is None:
            first = first.filter(step <= F.col("_step"))
        else:               # where the score of the last one is known, all branches that may reach it
            first = first.join(broadcast_if_small(settled), "lang", "left").filter(
                F.when(F.col("_floor").isNull(), step <= F.col("_step")).otherwise(F.col("bound") >= F.col("_floor")))
            first = first.join(broadcast_if_small(opened.select(F.col("code").alias("_opened"))),
                               F.col("code") == F.col("_opened"), "left_anti")
        first = pin_table(first.select("lang", "code", "n"), "phrase-open")
        if not first.limit(1).count():
            continue
        opened = first if opened is None else opened.unionByName(first)
        phrases = corpus.branches(first)
        if settled is not None:
            phrases = _hopeful(phrases, corpus, settled)
        made = pin_table(corpus.scored(phrases), "phrase-scored")
        found = made if found is None else found.unionByName(made)
        nth = Window.partitionBy("lang").orderBy(F.col("score").desc())
        settled = pin_table(found.select("lang", "score").withColumn("_n", F.row_number().over(nth))
                            .filter(F.col("_n") <= top).filter(F.col("_n") == top)
                            .select("lang", F.col("score").alias("_floor")), "phrase-floor")
    schema = "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint"
    if found is None:
        return corpus.spark.createDataFrame([], schema)
    best = found.join(broadcast_if_small(settled), "lang", "left").filter(
        F.col("score") >= F.coalesce("_floor", F.lit(-1))).drop("_floor").withColumn("_id", F.to_json(F.struct("codes")))
    spelled = lookup_join(best.select("_id", F.posexplode("codes").alias("_k", "code")), corpus.words.select("code", "word"), ["code"])
    texts = spelled.groupBy("_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_k", "word"))),
                                                                lambda x: x["word"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    return (best.join(texts, "_id").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


def _hopeful(phrases: DataFrame, corpus: _Corpus, settled: DataFrame) -> DataFrame:
    """The phrases that may reach the score of the last one by the cut before their last
    word (no other cut lifts the lowest)."""
    ends = corpus.words.select(F.col("code").alias("last"), F.col("n").alias("_r"))
    rows = (lookup_join(phrases, ends, ["last"]).join(broadcast_if_small(corpus.totals), "lang")
            .join(broadcast_if_small(settled), "lang", "left"))
    bound = F.expr("cast(1000 as decimal(38,0)) * cast(n as decimal(19,0)) * cast(total as decimal(16,0)) "
                   "div (cast(element_at(counts, -1) as decimal(19,0)) * cast(_r as decimal(19,0)))")
    return pin_table(rows.filter(F.col("_floor").isNull() | (bound >= F.col("_floor"))).select(*phrases.columns), "phrase-hopeful")
