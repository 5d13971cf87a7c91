"""Exact BM25 top-k search: an inverted index in shards, block-max WAND pruning inside
a shard, and an exact merge.

Documents are indexed where they are read, in segments of about ``SEGMENT_WORDS``
words (vocabulary, posting lists with term counts, document lengths); segments are a
written table. Document counts, lengths and document frequencies come from that
table and hold for the whole corpus, so every shard scores alike. Queries are taken in
blocks of about ``BLOCK_TERMS`` terms: a block, of that bounded size, is broadcast and
searched in all shards, so neither side is ever held whole. A task reads its part of the
table a segment at a time, neither shuffled nor sorted, and merges up to ``SHARD_WORDS``
words of them to a shard; it holds one shard, and keeps the best k of each query from one
shard to the next, which then skips whatever cannot reach the k-th best score so far.

Inside a task each query keeps the score its k-th best document has so far and skips
whatever cannot reach it, by the two WAND tests, taken for all documents of the shard
at once: (1) terms whose largest contributions add up to less than that score (in
fact, less than its share ``SKIP``, for tight bounds) cannot make a hit by themselves,
so only the other terms' postings are read; (2) a document
is scored in full only if what it has from those, plus the largest contributions of
the skipped terms in its block of ``BLOCK_DOCS`` documents, reaches that score.
Documents are scored best bound first, so the score to reach rises quickly. Full
scores add a document's terms in one fixed order, so shards, reruns and partitionings
agree to the last bit; ties go to the smaller id. Each task returns k rows per query at
most, and the best k of all are exact.

Terms are 64-bit hashes of words (runs of ASCII letters, digits and non-ASCII
characters, A-Z lower-cased). idf = ln(1 + (N - df + 0.5) / (df + 0.5)); a term counts
as often as the query has it.

Defined cases: null ids are neither indexed nor searched; a null or empty text is a
document of length 0 that is never found, and a query without results; rows that
repeat a document are documents of their own, rows that repeat a query id are one
query; fewer than k hits are all returned; empty tables give no rows; other columns
are ignored.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import pin_table
from .common import broadcast_if_small, pick, ship_package
from .text_hash import NOT_ALNUM, word_hashes

K = 10
K1, B = 1.2, 0.75
DIGITS = 9                   # decimals of the scores that the registered query returns
SEGMENT_WORDS = 1 << 20
SHARD_WORDS = 6 << 20
BLOCK_TERMS = 1_500_000
TASK_SHARDS = 8
TEXTS_AT_ONCE = 1000
INDEX_FILE = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1"}      # a row is megabytes: few are held at once
BLOCK_DOCS = 64
SCORE_AT_ONCE = 16
READ_AT_ONCE = 1 << 17       # postings
SKIP = 0.02                  # skipped terms add at most this share of the score to reach (at most 1)
_SLACK = 1 - 1e-9            # bounds and scores add in different orders

_SEGMENT = ("segment string, n_docs bigint, n_words bigint, terms array<bigint>, dfs array<int>, ids binary, "
            "lengths binary, docs binary, counts binary")


def term_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(term, text number, count) in that order of sorting, and the texts' lengths."""
    h, doc = word_hashes(texts, NOT_ALNUM)
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))) if len(h) else np.empty(
        0, np.int64)
    count = np.diff(np.concatenate((first, [len(h)])))
    return h[first], doc[first], count, np.bincount(doc, minlength=len(texts)).astype(np.int64)


def _index(batches):
    """(id, text) rows to segments."""
    import uuid

    import pyarrow as pa

    def segment(ids, texts):
        term, doc, count, lengths = term_counts(texts)
        start = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.empty(0, np.int64)
        row = [uuid.uuid4().hex, len(ids), int(lengths.sum()), term[start].view(np.int64),
               np.diff(np.concatenate((start, [len(term)]))).astype(np.int32), np.array(ids, np.int64).tobytes(),
               lengths.tobytes(), doc.astype(np.int32).tobytes(), count.astype(np.int32).tobytes()]
        return pa.RecordBatch.from_arrays(
            [pa.array([x], t) for x, t in zip(row, (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()),
                                                    pa.list_(pa.int32()), *[pa.binary()] * 4), strict=True)],
            ["segment", "n_docs", "n_words", "terms", "dfs", "ids", "lengths", "docs", "counts"])

    ids, texts, held = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).cast("binary").to_pylist(), strict=True):
            ids.append(i)
            texts.append(t or b"")
            held += len(texts[-1]) + 8
            if held >= 6 * SEGMENT_WORDS:          # about six bytes a word
                yield segment(ids, texts)
                ids, texts, held = [], [], 0
    if ids:
        yield segment(ids, texts)


def _query_terms(batches):
    """(id, text) to (query, term, count)."""
    import pyarrow as pa

    for b in batches:
        ids = b.column(0).to_numpy(zero_copy_only=False)
        term, doc, count, _ = term_counts([t or b"" for t in b.column(1).cast("binary").to_pylist()])
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[doc], pa.int64()), pa.array(term.view(np.int64)), pa.array(count, pa.int64())],
            ["query", "term", "count"])


def _slices(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The ranges of ``values`` one after another."""
    return np.concatenate([values[a:z] for a, z in zip(start.tolist(), end.tolist(), strict=True)] or [values[:0]])


class Shard:
    """Segments merged to one index, with upper bounds of contributions (in single
    precision, rounded up) and their maxima per term and per block of documents."""

    def __init__(self, segments: list[dict], mean_length: float, k1: float = K1, b: float = B):
        """``segments`` is emptied: a segment's memory goes as soon as it is merged."""
        ids, lengths = ([np.frombuffer(s[c], np.int64) for s in segments] for c in ("ids", "lengths"))
        n, self.k1 = sum(map(len, ids)), k1
        self.ids, length = np.concatenate(ids), np.concatenate(lengths)
        self.norm = k1 * (1 - b + b * length / max(mean_length, 1e-9))
        terms = np.sort(np.concatenate([np.asarray(s["terms"], np.int64).view(np.uint64) for s in segments]), kind="stable")
        self.terms = terms[np.concatenate(([True], terms[1:] != terms[:-1]))] if len(terms) else terms
        del terms, ids
        at = [np.searchsorted(self.terms, np.asarray(s["terms"], np.int64).view(np.uint64)).astype(np.int32) for s in segments]
        df = np.zeros(len(self.terms), np.int64)
        most = 0
        for t, s in zip(at, segments, strict=True):
            df[t] += np.asarray(s["dfs"], np.int64)
            most = max(most, int(np.frombuffer(s["counts"], np.int32).max(initial=0)))
        self.start = np.concatenate(([0], np.cumsum(df)))
        size = int(self.start[-1])
        # postings by term and by document, a segment at a time (its documents follow
        # those of the segments before), so that nothing but the index is large
        self.docs, self.part = np.empty(size, np.min_scalar_type(n)), np.empty(size, np.float32)
        self.fterm, self.fcount = np.empty(size, np.int32), np.empty(size, np.min_scalar_type(most))
        self.fstart = np.zeros(n + 1, np.int64)
        free, doc0, row0 = self.start[:-1].copy(), 0, 0
        segments.reverse()
        for t, length in zip(at, lengths, strict=True):
            s = segments.pop()
            dfs, docs, counts = np.asarray(s["dfs"], np.int64), np.frombuffer(s["docs"], np.int32), np.frombuffer(s["counts"], np.int32)
            to = np.arange(len(docs)) + np.repeat(free[t] - np.concatenate(([0], np.cumsum(dfs)[:-1])), dfs)
            free[t] += dfs
            self.docs[to] = docs + np.int32(doc0)
            exact = counts * (k1 + 1) / (counts + self.norm[docs + doc0])
            self.part[to] = exact * (1 + 2e-7)
            by_doc = np.argsort(docs.astype(np.min_scalar_type(len(length))), kind="stable")      # terms ascending inside a document
            self.fterm[row0:row0 + len(docs)] = np.repeat(t, dfs)[by_doc]
            self.fcount[row0:row0 + len(docs)] = counts[by_doc]
            self.fstart[doc0 + 1:doc0 + 1 + len(length)] = row0 + np.cumsum(np.bincount(docs, minlength=len(length)))
            doc0, row0 = doc0 + len(length), row0 + len(docs)
        self.blocks = -(-n // BLOCK_DOCS)
        if size:
            self.top = np.maximum.reduceat(self.part, self.start[:-1])
            block = self.docs // self.docs.dtype.type(BLOCK_DOCS) if n >= BLOCK_DOCS else np.zeros_like(self.docs)
            new = np.ones(size, bool)
            new[1:] = block[1:] != block[:-1]
            new[self.start[:-1]] = True
            first = np.flatnonzero(new)
            self.block_top, self.block = np.maximum.reduceat(self.part, first), block[first]
            self.block_start = np.searchsorted(first, self.start)
        self.place = np.zeros(len(self.terms), np.int32)

    def scores(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores; a document's terms are added in the order of their hashes.
        ``self.place`` has the place of the query's terms in ``weights``, from 1."""
        start, end = self.fstart[docs], self.fstart[docs + 1]
        place = self.place[_slices(self.fterm, start, end)]
        at = np.flatnonzero(place)
        size = end - start
        owner = np.repeat(np.arange(len(docs)), size)[at]
        count = self.fcount[at + (start - np.concatenate(([0], np.cumsum(size)[:-1])))[owner]]
        value = weights[place[at] - 1] * (count * (self.k1 + 1) / (count + self.norm[docs[owner]]))
        return np.bincount(owner, value, minlength=len(docs))

    def _added(self, owners: np.ndarray, tops: np.ndarray, start: np.ndarray, end: np.ndarray, weights: np.ndarray,
               n: int) -> np.ndarray:
        """The terms' ranges of ``tops``, weighted and added by owner; about ``READ_AT_ONCE``
        postings at a time, as a long query's may be as many as the shard has."""
        size, out = end - start, np.zeros(n)
        read = np.cumsum(size)
        i = 0
        while i < len(size):
            j = max(i + 1, int(np.searchsorted(read, (read[i - 1] if i else 0) + READ_AT_ONCE, "right")))
            out += np.bincount(_slices(owners, start[i:j], end[i:j]),
                               _slices(tops, start[i:j], end[i:j]) * np.repeat(weights[i:j], size[i:j]), minlength=n)
            i = j
        return out

    def partial(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What the terms add to every document at most."""
        return self._added(self.docs, self.part, self.start[terms], self.start[terms + 1], weights, len(self.ids))

    def find(self, terms: np.ndarray) -> np.ndarray:
        """Numbers of the terms in this shard, -1 for others."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        t = np.searchsorted(self.terms, terms)
        t[t == len(self.terms)] = 0
        return np.where(self.terms[t] == terms, t, -1)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The best k documents (ids, scores, best first) and how many were scored."""
        return self.best(self.find(terms), weights, k)

    def best(self, t: np.ndarray, w: np.ndarray, k: int, reach: float = 0.0) -> tuple[np.ndarray, np.ndarray, int]:
        """As ``search``, for numbers of terms. Documents that score less than ``reach``, the
        k-th best score known from other shards, may be left out."""
        here = t >= 0
        t, w = t[here], w[here]
        if not len(t):
            return np.empty(0, np.int64), np.empty(0), 0
        bound = w * self.top[t]
        order = np.argsort(-bound, kind="stable")
        t, w, bound = t[order], w[order], bound[order]
        self.place[t] = np.arange(1, len(t) + 1)
        left = np.concatenate((np.cumsum(bound[::-1])[::-1], [0.0]))       # bounds of term i and after
        best, score = np.empty(0, np.int64), np.empty(0)
        goal, scored = reach * _SLACK if reach > 0 else -1.0, 0

        def take(docs):
            nonlocal best, score, goal, scored
            best, score = np.concatenate((best, docs)), np.concatenate((score, self.scores(docs, w)))
            scored += len(docs)
            top = np.lexsort((self.ids[best], -score))[:k]
            best, score = best[top], score[top]
            if len(best) == k:
                goal = max(goal, score[-1] * _SLACK)

        few, part, done = 0, np.zeros(len(self.ids)), best
        if goal < 0:
            # documents that the strongest terms rank first give a score to reach
            read = np.cumsum(self.start[t + 1] - self.start[t])
            few = min(len(t), max(1, int(np.searchsorted(read, 2 * k * BLOCK_DOCS))))
            part = self.partial(t[:few], w[:few])
            found = np.flatnonzero(part)
            take(found[np.argpartition(-part[found], k)[:k]] if len(found) > k else found)
            done = best.copy()
        # terms from here on cannot reach the goal among themselves, by far: the less they
        # can add, the tighter the bounds below and the fewer documents are scored
        needed = min(len(t), max(few, int(np.searchsorted(-left, -goal * SKIP, "right")))) if goal > 0 else len(t)
        if needed > few:
            part += self.partial(t[few:needed], w[few:needed])
        part[done] = 0.0
        docs = np.flatnonzero(part)
        high = part[docs]
        if needed < len(t):
            near = high + left[needed] >= goal
            docs, high = docs[near], high[near]
            start, end = self.block_start[t[needed:]], self.block_start[t[needed:] + 1]
            rest = self._added(self.block, self.block_top, start, end, w[needed:], self.blocks)
            high = high + rest[docs // BLOCK_DOCS]
        while len(docs):
            ok = high >= goal
            docs, high = docs[ok], high[ok]
            if len(docs) > SCORE_AT_ONCE:
                at = np.argpartition(-high, SCORE_AT_ONCE)
                take(docs[at[:SCORE_AT_ONCE]])
                docs, high = docs[at[SCORE_AT_ONCE:]], high[at[SCORE_AT_ONCE:]]
            else:
                if len(docs):
                    take(docs)
                break
        self.place[t] = 0
        hit = score > 0
        return self.ids[best[hit]], score[hit], scored


def _search(k: int, mean_length: float, shard_words: int, block):
    """Segments, a row each, to the best k documents of every query of the block."""
    import pyarrow as pa

    def run(batches):
        query, start, distinct, places, weights = block.value
        ids, scores, hits = np.zeros((len(query), k), np.int64), np.zeros((len(query), k)), np.zeros(len(query), np.int64)

        def look(segments):
            shard = Shard(segments, mean_length)
            at = shard.find(distinct)
            for i in range(len(query)):
                a, z, n = start[i], start[i + 1], hits[i]
                d, s, _ = shard.best(at[places[a:z]], weights[a:z], k, scores[i, k - 1] if n == k else 0.0)
                if n and len(d):
                    d, s = np.concatenate((ids[i, :n], d)), np.concatenate((scores[i, :n], s))
                    top = np.lexsort((d, -s))[:k]
                    d, s = d[top], s[top]
                if len(d):
                    hits[i] = len(d)
                    ids[i, :len(d)], scores[i, :len(d)] = d, s

        held, words = [], 0
        for b in batches:
            for i in range(b.num_rows):
                n = b.column("n_words")[i].as_py()
                if held and words + n > shard_words:
                    look(held)
                    words = 0
                held.append({"terms": b.column("terms")[i].values.to_numpy(), "dfs": b.column("dfs")[i].values.to_numpy()}
                            | {c: b.column(c)[i].as_buffer() for c in ("ids", "lengths", "docs", "counts")})
                words += n
            del b
        if held:
            look(held)
        has = np.arange(k) < hits[:, None]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query, hits)), pa.array(ids[has]), pa.array(scores[has])],
                                         ["query_id", "doc_id", "score"])

    return run


@contextmanager
def _rows_at_once(spark, n: int):
    """Python is sent at most so many rows at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The segments of the inverted index, as a written table."""
    ship_package(docs.sparkSession)
    d = pick(docs, [id_col, text_col]).toDF("id", "text").filter("id is not null")
    with _rows_at_once(docs.sparkSession, TEXTS_AT_ONCE):
        return pin_table(d.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(_index, _SEGMENT), "bm25-index",
                         options=INDEX_FILE)


def search(index: DataFrame, queries: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
           k: int = K) -> DataFrame:
    """``query_id``, ``rank`` (1 is best), ``doc_id`` and ``score`` of the k best documents of
    every query. Ids must be integers."""
    spark = index.sparkSession
    ship_package(spark)
    n_docs, n_words = index.agg(F.sum("n_docs"), F.sum("n_words")).first()
    n_docs, n_words = n_docs or 0, n_words or 0
    q = pick(queries, [id_col, text_col]).toDF("id", "text").filter("id is not null")
    q = pin_table(q.select(F.col("id").cast("long").alias("id"), "text")
                  .mapInArrow(_query_terms, "query bigint, term bigint, count bigint")
                  .groupBy("query", "term").agg(F.sum("count").alias("count")), "bm25-query-terms")
    asked = broadcast_if_small(q.select(F.col("term").alias("asked")).distinct())
    df = (index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).select("t.terms", "t.dfs")
          .join(asked, F.col("terms") == F.col("asked"), "left_semi")
          .groupBy(F.col("terms").alias("term")).agg(F.sum("dfs").alias("df")))
    idf = F.log(1 + (F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = q.join(df, "term").select("query", "term", (F.col("count") * idf).alias("weight"))
    per = weighted.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("t"))
    per = pin_table(per.select("query", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights")), "bm25-queries")
    n_terms = per.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks, shards = -(-n_terms // BLOCK_TERMS) or 1, -(-n_words // SHARD_WORDS) or 1
    parts = index.select("n_words", "terms", "dfs", "ids", "lengths", "docs", "counts")
    # many small files would make many small shards: tasks read several, still in place
    tasks = max(4 * spark.sparkContext.defaultParallelism, -(-shards // TASK_SHARDS))
    if parts.rdd.getNumPartitions() > 2 * tasks:
        parts = parts.coalesce(tasks)
    found = None
    for i in range(blocks):
        got = per.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == i).toArrow()
        terms, weights = got.column("terms").combine_chunks(), got.column("weights").combine_chunks()
        sizes = np.diff(terms.offsets.to_numpy())
        distinct, places = np.unique(terms.flatten().to_numpy().view(np.uint64), return_inverse=True)
        shared = spark.sparkContext.broadcast((
            got.column("query").to_numpy(), np.concatenate(([0], np.cumsum(sizes))), distinct, places.astype(np.int32),
            weights.flatten().to_numpy()))
        with _rows_at_once(spark, 1):
            one = pin_table(parts.mapInArrow(_search(k, n_words / max(n_docs, 1), SHARD_WORDS, shared),
                                             "query_id bigint, doc_id bigint, score double"), "bm25-found")
        shared.destroy()
        found = one if found is None else found.unionByName(one)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score"))
