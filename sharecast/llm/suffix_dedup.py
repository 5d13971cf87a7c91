"""Exact substring deduplication with a column-wise suffix order of many strings.

Every byte covered by a ``LENGTH``-byte string that also starts earlier (in a
document of smaller id, or earlier in the same one) is removed.

The suffix order comes from the column-wise construction for collections: each round
inserts one more symbol of every string, in front of its suffix inserted last; the
place follows from the collection's Burrows-Wheeler transform (symbols before that
place that are smaller or equal), and the common-prefix lengths of the new neighbours
are one more than a range minimum over the lengths so far.

One round per symbol of a whole document would take as many passes over the whole
corpus as its longest text has bytes. So the strings are short pieces, cut so that
equal windows of LENGTH bytes always meet: each window belongs to the k-gram of
least hash in it (a minimizer), a piece is the run of windows that share one, and
pieces meet by that k-gram's hash. As equal windows have their k-gram at the same
place, the parts from the k-gram on are sorted once and stand as the strings' end
marks (in that order, with their common prefixes), and the rounds insert the symbols
to the left of it, at most LENGTH - K. The transform and the lengths are rewritten
front to back every round, as arrays of bounded size (a task takes ``STRINGS``
pieces at a time), not as files.

Steps: (1) cut each text into pieces where it is read; equal pieces of a task
collapse to their first; (2) pieces meet by k-gram hash and are scanned in order:
lone ones go, equal ones leave their first, whose later copies are covered, and firsts
with different bytes are kept for (3): their bytes are fetched from the texts and
ordered column-wise; strings of one k-gram beyond ``STRINGS`` are dealt to several
blocks, whose first windows meet again by digest; (4) covered windows of a document
are merged to spans and cut out of its text. Pieces are cut and compared with 64-bit
hashes (two per piece); what step 3 compares are bytes.

Defined cases: a null or empty text has no bytes; texts under LENGTH bytes are kept;
rows that repeat an id and a text are one document (each row gets its result); null
ids come last and texts that share an id follow in the order of their hashes; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import global_rank
from ..sources.files import pin_table
from .common import broadcast_if_small, pick, ship_package

LENGTH = 100
K = 32
STRINGS = 2048              # pieces ordered at once
CHUNK_BYTES = 1 << 19       # bytes hashed at once; positions must fit in 20 bits
_BASE = 0x9E3779B97F4A7C15 | 1
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Hashes of substrings by differences of prefix sums (arithmetic modulo 2**64)."""

    def __init__(self, size: int):
        self.power = np.multiply.accumulate(np.full(size, _BASE, np.uint64))
        self.inverse = np.multiply.accumulate(np.full(size, pow(_BASE, -1, 1 << 64), np.uint64))

    def sums(self, data: np.ndarray) -> np.ndarray:
        letters = _mix(np.arange(1, 257, dtype=np.uint64))[data]
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(letters * self.power[:len(data)])))

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((sums[end] - sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def _segments(texts: list[bytes], length: int):
    """Lists of (text number, offset, bytes) of about CHUNK_BYTES; a longer text is cut
    into segments that overlap by length - 1 bytes, so each window is in one of them."""
    out, held = [], 0
    for d, t in enumerate(texts):
        for at in range(0, max(len(t) - length + 1, 0), CHUNK_BYTES):
            part = t[at:at + CHUNK_BYTES + length - 1]
            if held + len(part) > CHUNK_BYTES + length and out:
                yield out
                out, held = [], 0
            out.append((d, at, part))
            held += len(part)
    if out:
        yield out


def shape_of(windows, left):
    return windows + (left << 16)


def windows_of(shape):
    return shape & 0xFFFF


def pieces(texts: list[bytes], hasher: Hasher, length: int = LENGTH, k: int = K):
    """Arrays (text number, start, shape, k-gram hash, piece hash) of all pieces; the shape
    holds the number of windows and the place of the k-gram (see :func:`shape_of`)."""
    found = []
    for seg in _segments(texts, length):
        data = np.frombuffer(b"".join(p for _, _, p in seg), np.uint8)
        sums = hasher.sums(data)
        starts = np.arange(len(data) - k + 1)
        grams = hasher.of(sums, starts, starts + k)
        low = (grams & ~np.uint64((1 << 20) - 1)) | starts.astype(np.uint64)
        width, span = length - k + 1, 1
        while span * 2 <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if width > span:
            low = np.minimum(low[:span - width], low[width - span:])
        owner = (low & np.uint64((1 << 20) - 1)).astype(np.int64)          # per window start
        sizes = np.array([len(p) for _, _, p in seg])
        base = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        windows = sizes - length + 1
        at = np.arange(windows.sum()) + np.repeat(base - np.concatenate(([0], np.cumsum(windows)[:-1])), windows)
        own = owner[at]
        first = np.concatenate(([True], (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)))
        head = np.flatnonzero(first)
        count = np.diff(np.concatenate((head, [len(at)])))
        s = at[head]
        n = np.searchsorted(base, s, "right") - 1
        docs, offs = np.array([d for d, _, _ in seg]), np.array([o for _, o, _ in seg])
        found.append((docs[n], s - base[n] + offs[n], shape_of(count, own[head] - s), grams[own[head]],
                      hasher.of(sums, s, s + count + length - 1)))
    if not found:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


_PIECE = "gram bigint, piece bigint, doc bigint, start bigint, shape int"


def _batch(columns, names, masks=None):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays(
        [pa.array(c, mask=None if masks is None else masks.get(n)) for c, n in zip(columns, names, strict=True)], names)


_NAMES = ["gram", "piece", "doc", "start", "shape"]


def _cut(length: int, k: int):
    """(doc, text) to pieces. Equal pieces of a task leave their first; the others
    are covered and come with a null gram."""
    def flush(held):
        doc, start, shape, gram, piece = (np.concatenate(x) for x in zip(*held, strict=True))
        gram, piece = gram.view(np.int64), piece.view(np.int64)
        order = np.lexsort((start, doc, piece, gram))
        doc, start, shape, gram, piece = (x[order] for x in (doc, start, shape, gram, piece))
        first = np.concatenate(([True], (gram[1:] != gram[:-1]) | (piece[1:] != piece[:-1])))
        at = np.flatnonzero(first)[np.cumsum(first) - 1]
        same = (doc == doc[at]) & (start == start[at])          # a repeated row, or the first itself
        keep = first | ~same
        covered = (~first & ~same)[keep]
        yield _batch([gram[keep], piece[keep], doc[keep], start[keep], shape[keep].astype(np.int32)], _NAMES,
                     {"gram": covered})

    def run(batches):
        hasher, held, rows = Hasher(CHUNK_BYTES + 2 * length), [], 0
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            got = pieces([t or b"" for t in b.column(1).to_pylist()], hasher, length, k)
            if len(got[0]):
                held.append((ids[got[0]], *got[1:]))
                rows += len(got[0])
            if rows >= 2_000_000:
                yield from flush(held)
                held, rows = [], 0
        if rows:
            yield from flush(held)

    return run


def _scan(batches):
    """Pieces in the order (gram, piece, doc, start). Covered pieces get a null gram;
    firsts of a gram that has different pieces keep theirs; the rest go."""
    import pyarrow as pa

    last = None                # (gram, piece, doc, start) of the first of the current piece
    waiting = None             # the gram's first piece, until another one turns up
    for b in batches:
        done = b.column(0).is_null()
        if done.true_count:
            yield b.filter(done)
            b = b.filter(pa.compute.invert(done))
        if not b.num_rows:
            continue
        gram, piece, doc, start, shape = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        goes_on = last is not None and last[0] == gram[0] and last[1] == piece[0]
        first = np.concatenate(([not goes_on], (gram[1:] != gram[:-1]) | (piece[1:] != piece[:-1])))
        at = np.cumsum(first)
        heads = np.flatnonzero(first)
        hdoc = np.concatenate(([last[2] if last else 0], doc[heads]))[at]
        hstart = np.concatenate(([last[3] if last else 0], start[heads]))[at]
        covered = ~first & ((doc != hdoc) | (start != hstart))
        out, extra = covered.copy(), None
        if len(heads):
            if waiting is not None and waiting[0] == gram[heads[0]]:
                extra = waiting
            same = gram[heads[1:]] == gram[heads[:-1]]
            before = np.concatenate(([last is not None and last[0] == gram[heads[0]]], same))
            met = before | np.concatenate((same, [False]))
            out[heads[met]] = True
            h = heads[-1]
            waiting = None if met[-1] else (gram[h], piece[h], doc[h], start[h], shape[h])
            last = (gram[h], piece[h], doc[h], start[h])
        if extra is not None:
            yield _batch([np.array([x]) for x in extra], _NAMES)
        if out.any():
            yield _batch([gram[out], piece[out], doc[out], start[out], shape[out]], _NAMES, {"gram": covered[out]})


def _fetch(length: int):
    """(text, pieces of it) to the pieces' bytes."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            gram, doc, start, left, data = [], [], [], [], []
            for d, text, found in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for p in found:
                    gram.append(p["gram"])
                    doc.append(d)
                    start.append(p["start"])
                    left.append(p["shape"] >> 16)
                    data.append(text[p["start"]:p["start"] + windows_of(p["shape"]) + length - 1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram, pa.int64()), pa.array(doc, pa.int64()), pa.array(start, pa.int64()),
                 pa.array(left, pa.int32()), pa.array(data, pa.binary())], ["gram", "doc", "start", "left", "data"])

    return run


def _range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, step: int = 8) -> np.ndarray:
    """min(values[lo:hi]) for each pair (lo < hi)."""
    pad = (-len(values)) % step
    padded = np.concatenate((values, np.full(pad + step, np.iinfo(values.dtype).max, values.dtype)))
    table = [padded[:len(values) + pad].reshape(-1, step).min(axis=1)]
    while len(table[-1]) > 1 and (1 << len(table)) <= len(table[0]):
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    out = np.full(len(lo), np.iinfo(values.dtype).max, values.dtype)
    first, last = -(-lo // step), hi // step
    wide = np.flatnonzero(last > first)
    if len(wide):
        level = np.floor(np.log2(last[wide] - first[wide])).astype(np.int64)
        for v in np.unique(level):
            w = wide[level == v]
            out[w] = np.minimum(table[v][first[w]], table[v][last[w] - (1 << v)])
    near = np.arange(step)
    for a, z in ((lo, np.minimum(hi, first * step)), (np.maximum(lo, last * step), hi)):
        some = np.flatnonzero(z > a)
        if len(some):
            at = a[some][:, None] + near
            out[some] = np.minimum(out[some], np.where(
                at < z[some][:, None], padded[np.minimum(at, len(padded) - 1)], np.iinfo(values.dtype).max).min(axis=1))
    return out


def _end_marks(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The parts' numbers in order, and the common prefix of each with the one before."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    size = np.array([len(parts[i]) for i in order], np.int64)
    table = np.zeros((len(parts), int(size.max(initial=0))), np.uint8)
    for row, i in enumerate(order):
        table[row, :len(parts[i])] = np.frombuffer(parts[i], np.uint8)
    lcp = np.zeros(len(parts), np.int16)
    if len(parts) > 1 and table.shape[1]:
        differ = table[1:] != table[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), table.shape[1])
        lcp[1:] = np.minimum(first, np.minimum(size[1:], size[:-1]))
    return np.array(order, np.int64), lcp


def column_wise_order(strings: list[bytes], parts: list[bytes] | None = None
                      ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes of the strings in order: string number, suffix length, and common
    prefix with the one before. Every string ends in a mark smaller than any symbol;
    marks follow the order of ``parts``, whose common prefixes count (without parts: the
    order of the strings, nothing in common)."""
    m = len(strings)
    if parts is None:
        marks, start = np.arange(m), np.zeros(m, np.int16)
    else:
        marks, start = _end_marks(parts)
    size = np.array([len(s) for s in strings], np.int64)
    top = int(size.max(initial=0))
    # symbols 1..256 from the back; 0 stands for "whole string inserted"
    column = np.zeros((top + 1, m), np.uint16)
    for i, s in enumerate(strings):
        column[:len(s), i] = np.frombuffer(s, np.uint8)[::-1].astype(np.uint16) + 1
    bwt, lcp = column[0][marks], start
    who, length = marks.astype(np.int32), np.zeros(m, np.int16)
    place = np.empty(m, np.int64)                     # of each string's last inserted suffix
    place[marks] = np.arange(m)
    for r in range(1, top + 1):
        active = np.flatnonzero(size >= r)
        by_symbol = np.argsort(bwt, kind="stable")    # 16-bit keys: a counting sort
        ended = len(bwt) - np.count_nonzero(bwt)
        order = by_symbol[ended:]                     # place of each suffix without its first symbol
        is_new = np.zeros(len(bwt), bool)
        is_new[place[active]] = True
        rank = np.flatnonzero(is_new[order])          # of new suffixes among all that have a symbol
        source = order[rank]
        symbol = bwt[source]
        total = len(order)
        back = np.zeros(len(rank), np.int16)
        left = np.flatnonzero((rank > 0) & (bwt[order[rank - 1]] == symbol))
        back[left] = 1 + _range_min(lcp, order[rank[left] - 1] + 1, source[left] + 1)
        nxt = np.minimum(rank + 1, total - 1)
        right = np.flatnonzero((rank + 1 < total) & (bwt[order[nxt]] == symbol))
        ahead = np.zeros(len(rank), np.int16)
        ahead[right] = 1 + _range_min(lcp, source[right] + 1, order[nxt[right]] + 1)
        target = m + rank
        string = who[source]
        old = np.ones(len(bwt) + len(rank), bool)
        old[target] = False

        def merged(before, new, old=old, target=target):
            out = np.empty(len(old), before.dtype)
            out[old] = before
            out[target] = new
            return out

        bwt = merged(bwt, column[r, string])
        lcp = merged(lcp, back)
        lcp[np.minimum(target + 1, len(lcp) - 1)[target + 1 < len(lcp)]] = ahead[target + 1 < len(lcp)]
        who = merged(who, string)
        length = merged(length, np.int16(r))
        place[string] = target
    return who, length, lcp


def repeated_windows(data: list[bytes], left: np.ndarray, doc: np.ndarray, start: np.ndarray, length: int):
    """Windows of ``length`` bytes of the pieces: group (of equal ones), doc and start, in
    the order of group, doc, start. ``left`` is the place of a piece's k-gram."""
    rest = [t[n:] for t, n in zip(data, left.tolist(), strict=True)]
    who, size, lcp = column_wise_order([t[:n] for t, n in zip(data, left.tolist(), strict=True)], rest)
    whole = size + np.array([len(t) for t in rest], np.int64)[who]
    group, long = np.cumsum(lcp < length), whole >= length
    who, size, group = who[long], size[long].astype(np.int64), group[long]
    d, s = doc[who], start[who] + left[who] - size
    order = np.lexsort((s, d, group))
    return group[order], d[order], s[order]


def _order(length: int):
    """One block of pieces to covered windows (null digest) and, for k-grams that were
    dealt to several blocks, the first window of each group with its digest."""
    import hashlib

    import pandas as pd

    def runs(doc, start):
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order]
        new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)))
        head = np.flatnonzero(new)
        tail = np.concatenate((head[1:], [len(doc)])) - 1
        return doc[head], start[head], start[tail] - start[head] + 1

    def run(pdf):
        out = []
        pdf = pdf.sort_values(["gram", "doc", "start"], kind="stable").reset_index(drop=True)
        grams = pdf["gram"].to_numpy()
        edges = np.concatenate(([0], np.flatnonzero(grams[1:] != grams[:-1]) + 1, [len(pdf)]))
        at = 0
        while at < len(pdf):
            fit = np.searchsorted(edges, at + STRINGS, "right") - 1
            end = int(edges[max(fit, np.searchsorted(edges, at, "right"))])
            part = pdf.iloc[at:end]
            at = end
            data, doc, start = list(part["data"]), part["doc"].to_numpy(), part["start"].to_numpy()
            group, d, s = repeated_windows(data, part["left"].to_numpy(), doc, start, length)
            if not len(group):
                continue
            first = np.concatenate(([True], group[1:] != group[:-1]))
            lead = np.flatnonzero(first)[np.cumsum(first) - 1]
            covered = (d != d[lead]) | (s != s[lead])
            if covered.any():
                cd, cs, cn = runs(d[covered], s[covered])
                out.append(pd.DataFrame({"digest": None, "doc": cd, "start": cs, "windows": cn}))
            if part["blocks"].iloc[0] > 1:
                text = {}
                for x, a, t in zip(doc, start, data, strict=True):
                    for i in range(len(t) - length + 1):
                        text[x, a + i] = t[i:i + length]
                heads = [(hashlib.md5(text[x, y]).digest(), x, y) for x, y in zip(d[first], s[first], strict=True)]
                out.append(pd.DataFrame(heads, columns=["digest", "doc", "start"]).assign(windows=1))
        if not out:
            return pd.DataFrame({"digest": [], "doc": [], "start": [], "windows": []}).astype(
                {"doc": "int64", "start": "int64", "windows": "int64"})
        return pd.concat(out, ignore_index=True)

    return run


def _remove(length: int):
    """(…, text, covered windows) to spans and the bytes left."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            spans, kept = [], []
            for text, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                text, merged = text or b"", []
                for a, z in sorted((x["start"], x["start"] + x["windows"] - 1 + length) for x in found or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], z)
                    else:
                        merged.append([a, z])
                left, at = [], 0
                for a, z in merged:
                    left.append(text[at:a])
                    at = z
                kept.append(b"".join([*left, text[at:]]))
                spans.append([{"start": a, "end": z} for a, z in merged])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(kept, pa.binary())], ["id", "spans", "kept"])

    return run


def _numbered(d: DataFrame) -> DataFrame:
    """(id, text, doc): doc orders the documents. It is the id where ids are unique."""
    n, known, ids = d.agg(F.count(F.lit(1)), F.count("id"), F.count_distinct("id")).first()
    if n == known == ids:
        return d.withColumn("doc", F.col("id"))
    d = d.withColumn("h", F.xxhash64("text"))
    ranked = global_rank(d.select("id", "h").distinct(), [F.col("id").asc_nulls_last(), F.col("h").asc()], rank_col="doc")
    ranked = ranked.withColumnsRenamed({"id": "rid", "h": "rh"})
    return d.join(ranked, F.col("id").eqNullSafe(F.col("rid")) & (F.col("h") == F.col("rh"))).select("id", "text", "doc")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                   length: int = LENGTH, k: int = K) -> DataFrame:
    """Per document: ``id_col``, ``n_bytes``, ``spans`` (removed, as start and end bytes) and
    ``kept`` (the other bytes). Ids must be integers."""
    d = pick(docs, [id_col, text_col]).toDF("id", "text").select(
        F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    d = _numbered(d)
    spark = d.sparkSession
    ship_package(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = d.select("doc", "text").mapInArrow(_cut(length, k), _PIECE)
    dealt = (cut.repartition(parts, F.coalesce("gram", F.xxhash64("doc", "start")))
             .sortWithinPartitions("gram", "piece", "doc", "start"))
    met = pin_table(dealt.mapInArrow(_scan, _PIECE), "repeat-pieces")
    covered = met.filter("gram is null").select("doc", "start", F.col("shape").bitwiseAND(0xFFFF).cast("long").alias("windows"))
    open_ = met.filter("gram is not null")
    lists = pin_table(open_.groupBy("doc").agg(F.collect_list(F.struct("gram", "start", "shape")).alias("found"))
                      .withColumnRenamed("doc", "fdoc"), "repeat-lists")
    sizes = open_.groupBy("gram").agg(F.ceil(F.count(F.lit(1)) / STRINGS).cast("int").alias("blocks"))
    many = broadcast_if_small(pin_table(sizes.filter("blocks > 1").withColumnRenamed("gram", "mgram"), "repeat-hot"))
    texts = d.join(broadcast_if_small(lists), F.col("doc") == F.col("fdoc"))
    bins = max(parts, open_.count() // STRINGS + 1)
    data = texts.select("doc", "text", "found").mapInArrow(
        _fetch(length), "gram bigint, doc bigint, start bigint, left int, data binary")
    data = (data.join(many, F.col("gram") == F.col("mgram"), "left")
            .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
            .withColumn("block", F.pmod(F.xxhash64("doc", "start"), F.col("blocks")))
            .withColumn("bin", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("gram"), F.lit(bins)))
                        .otherwise(F.col("gram"))))
    ordered = pin_table(data.groupBy("bin", "block", F.col("blocks").alias("of")).applyInPandas(
        _order(length), "digest binary, doc bigint, start bigint, windows bigint"), "repeat-windows")
    heads = ordered.filter("digest is not null")
    least = heads.groupBy("digest").agg(F.min(F.struct("doc", "start")).alias("least"))
    again = heads.join(least, "digest").filter(F.struct("doc", "start") > F.col("least"))
    columns = ["doc", "start", "windows"]
    covered = (covered.union(ordered.filter("digest is null").select(*columns)).union(again.select(*columns))
               .groupBy("doc").agg(F.collect_set(F.struct("start", "windows")).alias("found"))
               .withColumnRenamed("doc", "cdoc"))
    both = d.join(broadcast_if_small(pin_table(covered, "repeat-covered")), F.col("doc") == F.col("cdoc"), "left")
    return (both.select("id", "text", "found").mapInArrow(
        _remove(length), "id bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
        .select(F.col("id").alias(id_col),
                (F.octet_length("kept") + F.coalesce(F.aggregate(
                    "spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]), F.lit(0))).alias("n_bytes"),
                "spans", "kept"))


def repeat_digests(result: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return result.select("doc_id", F.col("n_bytes").cast("long").alias("n_bytes"), removed.alias("n_removed"),
                         F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
