"""Exact similarity join of documents by the Jaccard of their word n-grams, as a
size-aware heavy-light join.

Sets of n-gram hashes are found with numpy per batch of documents. Two sets can only
reach the threshold t if few of their elements differ, which gives the candidates:

* small sets (below a boundary) enumerate the subsets of exactly as many elements as
  a partner must share, and meet on an equal subset;
* large sets go to inverted lists. A single n-gram's list is as long as the most
  quoted phrase, so the lists are keyed by groups of n-grams instead: elements are
  dealt by hash into more groups than may differ, so that two sets within the
  threshold have a whole group in common (pigeonhole). Sets meet per size class.

The boundary is set by cost: the largest size up to which enumerating makes at most
``SUBSET_COST`` times as many keys as the lists would.

Keys that several documents of one task share are linked there to the least of them,
so a key reaches the shuffle once per task however many documents hold it; the lists
are then scanned in key order and yield one link per entry, never pairs. Near copies
share most of their keys and would be linked once in every task that has one of these,
so keys are scanned twice: first the ``PILOT`` least keys of every document, which link
nearly all near copies; then all keys, with each document under the least id it is linked
to so far, so that a list only links what is not linked yet. Linked documents form
candidate clusters, where equal sets collapse to one representative.

Texts that share a passage may chain into one large cluster without a true link. A
cluster of more than ``BLOCK_ITEMS`` elements therefore first counts, in one shuffle of
its elements, how many of every set's occur in another of its sets: a set of which less
than the threshold's part does has no partner and goes (the others keep their cluster).
The rest is ordered by size and cut into blocks of about ``BLOCK_ITEMS`` elements, and
only pairs of blocks whose sizes are near enough for the threshold meet; smaller
clusters share tasks. A task counts common elements over inverted lists and keeps a
spanning forest of the pairs that really reach t. Their components are the result.
Tables of the way are deleted once the links are written.

Defined cases: a null text, or one without words, has an empty set and links with
nothing; fewer than n words make one n-gram of all; null ids get no component; rows
that repeat an id are one node, linked by any of its texts, and each get a row; an
empty table gives no rows; other columns are ignored. Sets are sets of 64-bit hashes.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import lookup_join
from ..operators.ranks import PID, POS, freeze_order, rank_and_accumulate
from ..sources.files import drop_files, pin_table, release_shuffles
from .common import broadcast_if_small, pick, ship_package
from .components import connected_components, shorten
from .text_hash import BLANKS, CHUNK_BYTES, C1, C2, GOLD, mix, word_hashes

NGRAM = 3
NUM, DEN = 90, 100          # the threshold as a fraction
SUBSET_COST = 2
SPARE = 2                   # least groups beyond those that may differ; see spare_groups
BLOCK_ITEMS = 1_000_000
PILOT = 4                   # keys of a document that are scanned ahead of the others


def ngram_sets(texts: list[bytes], n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """All documents' distinct n-gram hashes, ascending inside each document, and the
    offsets of the documents in them."""
    h, doc = word_hashes(texts, BLANKS)
    count = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), np.int64)
    weights = mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    m = max(len(h) - n + 1, 0)
    grams = np.zeros(m, np.uint64)
    for k in range(n):
        grams += mix(h[k:k + m] ^ weights[k]) * weights[k]
    whole = doc[:m] == doc[n - 1:n - 1 + m] if m else np.zeros(0, bool)
    grams, owner = mix(grams[whole]), doc[:m][whole]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        first = np.concatenate(([0], np.cumsum(count)[:-1]))
        extra = []
        for d in short:
            w = h[first[d]:first[d] + count[d]]
            extra.append((mix(w ^ weights[:len(w)]) * weights[:len(w)]).sum(dtype=np.uint64) + np.uint64(len(w)))
        grams, owner = np.concatenate((grams, mix(np.array(extra, np.uint64)))), np.concatenate((owner, short))
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    if len(grams):
        new = np.concatenate(([True], (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])))
        grams, owner = grams[new], owner[new]
    return grams, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(texts)))))


def needed(a: int, b: int, num: int, den: int) -> int:
    """Common elements that sets of these sizes must have to reach num/den."""
    return -(-num * (a + b) // (num + den))


@lru_cache(maxsize=None)
def overlaps(size: int, num: int, den: int) -> tuple[int, ...]:
    """The overlaps that partners of any possible size ask of a set."""
    lo, hi = -(-size * num // den), size * den // num
    return tuple(sorted({needed(size, other, num, den) for other in range(lo, hi + 1)}))


def size_class(size: np.ndarray, num: int, den: int) -> np.ndarray:
    """Classes so wide that partners are in the same or in neighbouring ones."""
    return np.floor(np.log(size) / math.log(den / num * 1.001)).astype(np.int64)


def spare_groups(differ: int, smallest: int) -> int:
    """Groups to have beyond ``differ`` + 1, so that sets from ``smallest`` elements on
    get few keys for empty groups (see group_keys): from SPARE up, the first number for
    which a set is expected to get one such key at most, or that lies six deviations above
    the expected number of empty groups. Below a threshold of about 0.62 there is none."""
    for spare in range(SPARE, 8 * differ + 64):
        groups, k = differ + 1 + spare, spare + 1
        keys = (math.lgamma(groups + 1) - math.lgamma(k + 1) - math.lgamma(groups - k + 1)
                + smallest * math.log1p(-k / groups)) if k < groups else 0
        empty = groups * (1 - 1 / groups) ** smallest
        if keys <= 0 or spare >= empty + 6 * math.sqrt(empty):
            return spare
    return SPARE


def class_differ(c: int, num: int, den: int) -> int:
    """Elements in which a pair may differ whose smaller set is of class c."""
    return (math.floor((den / num * 1.001) ** (c + 1)) + 1) * (den - num) // num


@lru_cache(maxsize=None)
def class_spare(c: int, num: int, den: int) -> int:
    return spare_groups(class_differ(c, num, den), math.ceil((den / num * 1.001) ** c))


@lru_cache(maxsize=None)
def class_groups(c: int, num: int, den: int) -> int:
    """Groups for pairs whose smaller set is of class c: more than may differ."""
    return class_differ(c, num, den) + 1 + class_spare(c, num, den)


@lru_cache(maxsize=None)
def boundary(num: int, den: int) -> int:
    """The size from which on sets go to the lists."""
    size = 1
    while True:
        c = int(size_class(np.array([size]), num, den)[0])
        lists = class_groups(c, num, den) + (class_groups(c - 1, num, den) if c else 0)
        if sum(math.comb(size, k) for k in overlaps(size, num, den)) > SUBSET_COST * lists:
            return size
        size += 1


def subset_keys(grams: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of a small set: its subsets of each overlap a partner may ask for."""
    m = mix(grams ^ C1)
    total, out = m.sum(dtype=np.uint64, keepdims=True), []
    for k in overlaps(len(grams), num, den):
        left_out = np.array(list(combinations(range(len(m)), len(m) - k)), np.int64).reshape(
            math.comb(len(m), k), len(m) - k)
        kept = total - m[left_out].sum(axis=1, dtype=np.uint64)
        out.append(mix(kept ^ mix(np.array([k], np.uint64))))
    return np.concatenate(out)


def group_keys(grams: np.ndarray, offsets: np.ndarray, docs: np.ndarray, tags: np.ndarray,
               num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the groups of large sets under a class tag each, and their documents.

    A group without elements says nothing by itself. With so many spare groups more than
    needed, a partner agrees in a group that has elements unless both lack more groups
    than are spare; such sets (very few, as the spare groups grow with the number of
    groups) also get a key per spare + 1 empty groups."""
    if not len(docs):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    groups = np.array([class_groups(int(c), num, den) for c in tags], np.int64)
    spare = np.array([class_spare(int(c), num, den) for c in tags], np.int64)
    base = np.concatenate(([0], np.cumsum(groups)))
    size = offsets[docs + 1] - offsets[docs]
    at = np.arange(size.sum()) - np.repeat(np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.repeat(
        offsets[docs], size)
    g = mix(grams[at] ^ np.repeat(tags, size).astype(np.uint64) * GOLD)
    slot = np.repeat(base[:-1], size) + (g % np.repeat(groups, size).astype(np.uint64)).astype(np.int64)
    acc = np.zeros(base[-1], np.uint64)
    np.add.at(acc, slot, mix(g))
    filled = np.zeros(base[-1], bool)
    filled[slot] = True
    owner, tag = np.repeat(np.arange(len(docs)), groups), np.repeat(tags, groups)
    number = np.arange(base[-1]) - np.repeat(base[:-1], groups)
    salt = mix(tag.astype(np.uint64) * C1 + number.astype(np.uint64))
    keys, of = mix(acc ^ salt)[filled], docs[owner[filled]]
    empties = groups - np.bincount(owner[filled], minlength=len(docs))
    more = []
    for i in np.flatnonzero(empties > spare):
        blank = salt[base[i]:base[i + 1]][~filled[base[i]:base[i + 1]]]
        more += [(mix(np.array([sum(map(int, x)) & (2 ** 64 - 1)], np.uint64))[0], docs[i])
                 for x in combinations(blank, int(spare[i]) + 1)]
    if more:
        keys = np.concatenate((keys, np.array([x[0] for x in more], np.uint64)))
        of = np.concatenate((of, np.array([x[1] for x in more], np.int64)))
    return keys, of


def candidate_keys(grams: np.ndarray, offsets: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, document number) of all keys by which the sets may meet a partner."""
    size, x = np.diff(offsets), boundary(num, den)
    keys, of = [], []
    for d in np.flatnonzero((size > 0) & (size < x)):
        k = subset_keys(grams[offsets[d]:offsets[d + 1]], num, den)
        keys.append(k)
        of.append(np.full(len(k), d))
    large = np.flatnonzero(size * den >= x * num)
    if len(large):
        c = size_class(size[large], num, den)
        for docs, tags in ((large, c), (large[c > 0], c[c > 0] - 1)):
            k, d = group_keys(grams, offsets, docs, tags, num, den)
            keys.append(k)
            of.append(d)
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(keys), np.concatenate(of)


def _texts(column) -> list[bytes]:
    return [t or b"" for t in column.cast("binary").to_pylist()]


def _chunks(texts: list[bytes]):
    """Runs of texts of about CHUNK_BYTES."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= CHUNK_BYTES:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _document_keys(n: int, num: int, den: int):
    """(id, text) to (id, keys): a document's distinct keys in ascending order, as bytes."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            texts = _texts(b.column(1))
            for lo, hi in _chunks(texts):
                keys, of = candidate_keys(*ngram_sets(texts[lo:hi], n), num, den)
                order = np.lexsort((keys, of))
                keys, of = keys[order], of[order]
                if len(keys):
                    new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])))
                    keys, of = keys[new], of[new]
                at = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=hi - lo)))) * 8
                data = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(keys)])
                made = pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), data.cast(pa.binary())], ["id", "keys"])
                yield made.filter(pa.array(at[1:] > at[:-1]))

    return run


def _emit_keys(first: int | None = None):
    """(id, keys) to rows per task: (key, least id of the task, null) per key, and a link
    (null, id, least id) for each other document that has it. With ``first`` only so many
    keys of a document."""
    import pyarrow as pa

    def flush(keys, ids):
        k, i = np.concatenate(keys), np.concatenate(ids)
        order = np.lexsort((i, k))
        k, i = k[order], i[order]
        first = np.concatenate(([True], k[1:] != k[:-1]))
        least = i[np.flatnonzero(first)][np.cumsum(first) - 1]
        link = np.unique(np.stack((i[~first], least[~first])), axis=1) if (~first).any() else np.empty((2, 0), np.int64)
        link = link[:, link[0] != link[1]]
        key = np.concatenate((k[first].view(np.int64), np.zeros(link.shape[1], np.int64)))
        is_link = np.arange(len(key)) >= first.sum()
        yield pa.RecordBatch.from_arrays(
            [pa.array(key, pa.int64(), mask=is_link), pa.array(np.concatenate((i[first], link[0])), pa.int64()),
             pa.array(np.concatenate((np.zeros(first.sum(), np.int64), link[1])), pa.int64(), mask=~is_link)],
            ["key", "id", "least"])

    def run(batches):
        keys, ids, held = [], [], 0
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                keys.append(np.frombuffer(x.as_buffer(), np.uint64)[:first])
                ids.append(np.full(len(keys[-1]), i))
                held += len(keys[-1])
                if held >= 4_000_000:
                    yield from flush(keys, ids)
                    keys, ids, held = [], [], 0
        if held:
            yield from flush(keys, ids)

    return run


def _scan_lists(batches):
    """Rows in key order to links: those found in the tasks (their key is null), and one
    from each entry of a list to the list's first id; a task's links are shortened."""
    return shorten(_list_links(batches))


def _list_links(batches):
    import pyarrow as pa

    key, head = None, 0
    for b in batches:
        link = b.column(0).is_null()
        if link.true_count:
            yield b.filter(link).select(["id", "least"])
            b = b.filter(pa.compute.invert(link))
        if not b.num_rows:
            continue
        k = b.column(0).to_numpy(zero_copy_only=False)
        i = b.column(1).to_numpy(zero_copy_only=False)
        first = np.concatenate(([key is None or k[0] != key], k[1:] != k[:-1]))
        heads = np.concatenate(([head], i[first]))[np.cumsum(first)]
        key, head = k[-1], heads[-1]
        other = heads != i
        if other.any():
            pair = np.unique(np.stack((i[other], heads[other])), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["id", "least"])


def _key_links(keyed: DataFrame, parts: int, first: int | None = None) -> DataFrame:
    """Links (id, least) of the documents (id, keys) that share one of their (``first``) keys."""
    rows = keyed.mapInArrow(_emit_keys(first), "key bigint, id bigint, least bigint")
    dealt = rows.repartition(parts, F.coalesce("key", F.xxhash64("id"))).sortWithinPartitions("key", "id")
    return dealt.mapInArrow(_scan_lists, "id bigint, least bigint")


def _digest(grams: np.ndarray) -> bytes:
    return b"".join(mix(grams ^ c).sum(dtype=np.uint64).tobytes() for c in (C1, C2))


def _measure(n: int):
    """(id, cluster, text) to (id, cluster, size, digest); digests only in clusters."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            texts = _texts(b.column(2))
            member = b.column(1).is_valid().to_numpy(zero_copy_only=False)
            sizes, digests = [], []
            for lo, hi in _chunks(texts):
                grams, off = ngram_sets(texts[lo:hi], n)
                sizes.append(np.diff(off))
                digests += [_digest(grams[off[d]:off[d + 1]]) if member[lo + d] else None for d in range(hi - lo)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.concatenate(sizes) if sizes else [], pa.int64()),
                 pa.array(digests, pa.binary())], ["id", "cluster", "size", "digest"])

    return run


def _collect_sets(n: int):
    """(id, cluster, text) to (id, cluster, size, digest, items), the set itself."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            texts = _texts(b.column(2))
            for lo, hi in _chunks(texts):
                grams, off = ngram_sets(texts[lo:hi], n)
                sets = [grams[off[d]:off[d + 1]] for d in range(hi - lo)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(np.diff(off), pa.int64()),
                     pa.array([_digest(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())],
                    ["id", "cluster", "size", "digest", "items"])

    return run


def _elements(batches):
    """(sid, cluster, items) to a row (element of the cluster, sid) per element."""
    import pyarrow as pa

    for b in batches:
        cluster = mix(b.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
        for i, (sid, items) in enumerate(zip(b.column(0).to_pylist(), b.column(2), strict=True)):
            e = mix(np.frombuffer(items.as_buffer(), np.uint64) ^ cluster[i]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(e), pa.array(np.full(len(e), sid))], ["element", "sid"])


def _shared_elements(batches):
    """Rows in the order of elements to (sid, elements that another set has as well)."""
    import pyarrow as pa

    kept, ids = None, []

    def total():
        sid, n = np.unique(np.concatenate(ids), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(sid), pa.array(n)], ["sid", "shared"])

    for b in batches:
        if not b.num_rows:
            continue
        e, s = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        if kept is not None:        # the last row of the batch before, and whether it is counted
            e, s = np.concatenate(([kept[0]], e)), np.concatenate(([kept[1]], s))
        same = e[1:] == e[:-1]
        hit = np.concatenate((same, [False])) | np.concatenate(([False], same))
        if kept is not None and kept[2]:
            hit[0] = False
        ids.append(s[hit])
        kept = (e[-1], s[-1], bool(hit[-1]))
        if sum(map(len, ids)) >= 4_000_000:
            yield total()
            ids = []
    if ids:
        yield total()


def linked_pairs(owner: np.ndarray, items: np.ndarray, sizes: np.ndarray, cluster: np.ndarray,
                 side: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets that reach num/den.

    ``owner`` and ``items`` are all (set number, element), ``side`` 0 or 1; sets of one
    cluster are compared, with those of the other side if there are two sides."""
    items = mix(items ^ mix(cluster.astype(np.uint64))[owner])
    order = np.argsort(items, kind="stable")
    items, owner_s = items[order], owner[order]
    first = np.concatenate(([True], items[1:] != items[:-1])) if len(items) else np.zeros(0, bool)
    rank = np.cumsum(first) - 1
    starts = np.concatenate((np.flatnonzero(first), [len(items)]))
    freq = np.diff(starts)
    by_set = np.argsort(owner_s, kind="stable")
    rank_by_set = rank[by_set]
    bounds = np.concatenate(([0], np.cumsum(np.bincount(owner_s, minlength=len(sizes)))))
    two = len(np.unique(side)) > 1
    parent = np.arange(len(sizes))
    out = []
    for a in range(len(sizes)):
        r = rank_by_set[bounds[a]:bounds[a + 1]]
        r = r[freq[r] > 1]
        if not len(r):
            continue
        f = freq[r]
        at = np.arange(f.sum()) + np.repeat(starts[r] - np.concatenate(([0], np.cumsum(f)[:-1])), f)
        common = np.bincount(owner_s[at], minlength=len(sizes))
        hit = np.flatnonzero(den * common >= num * (sizes[a] + sizes - common))
        hit = hit[(hit != a) & ((side[hit] != side[a]) if two else True)]
        hit = hit[parent[hit] != parent[a]]
        while len(hit):
            b = hit[0]
            out.append((a, int(b)))
            parent[parent == parent[b]] = parent[a]
            hit = hit[parent[hit] != parent[a]]
    return out


def _verify(num: int, den: int):
    import pandas as pd

    def run(pdf):
        pdf = pdf.sort_values(["cluster", "id"], kind="stable")
        sets = [np.frombuffer(x, np.uint64) for x in pdf["items"]]
        sizes = np.array([len(s) for s in sets], np.int64)
        pairs = linked_pairs(np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets), sizes,
                             pdf["cluster"].to_numpy(), pdf["side"].to_numpy(), num, den)
        ids = pdf["id"].to_numpy()
        return pd.DataFrame({"a": [ids[x] for x, _ in pairs], "b": [ids[y] for _, y in pairs]}).astype("int64")

    return run


def _may_have_partner(sets: DataFrame, parts: int, num: int, den: int) -> DataFrame:
    """The sets (sid, cluster, size, items) of which num/den or more lies in other sets of
    the cluster; a partner shares that much at least."""
    rows = sets.select("sid", "cluster", "items").mapInArrow(_elements, "element bigint, sid bigint")
    dealt = rows.repartition(parts, "element").sortWithinPartitions("element")
    counts = (dealt.mapInArrow(_shared_elements, "sid bigint, shared bigint").groupBy("sid").agg(F.sum("shared").alias("shared")))
    able = pin_table(counts, "near-shared")
    return lookup_join(sets, able, ["sid"]).filter(F.col("shared") * den >= F.col("size") * num).drop("shared")


def _block_tasks(sets: DataFrame, num: int, den: int) -> DataFrame:
    """The sets (sid, cluster, id, size, items) per pair (i, j) of blocks of their cluster
    that must be compared; side is 1 for those of block j if there are two."""
    frozen = freeze_order(sets.select("cluster", "sid", "size"), ["cluster"], [F.col("size").asc(), F.col("sid").asc()])
    order = rank_and_accumulate(frozen, ["cluster"], sums=["size"]).drop(PID, POS)
    blocks = pin_table(order.select("sid", "cluster", "size", F.floor((F.col("cum_size") - 1) / BLOCK_ITEMS).cast("int").alias("block")),
                       "near-blocks")
    extent = blocks.groupBy("cluster", "block").agg(F.min("size").alias("least"), F.max("size").alias("most"))
    other = extent.select("cluster", F.col("block").alias("j"), F.col("least").alias("next"))
    pairs = (extent.join(other, "cluster").filter((F.col("j") >= F.col("block")) & (F.col("next") * num <= F.col("most") * den))
             .select("cluster", F.col("block").alias("i"), "j"))
    sides = F.when(F.col("i") == F.col("j"), F.array(F.struct(F.col("i").alias("block"), F.lit(0).alias("side")))).otherwise(
        F.array(F.struct(F.col("i").alias("block"), F.lit(0).alias("side")), F.struct(F.col("j").alias("block"), F.lit(1).alias("side"))))
    meet = pairs.select("cluster", "i", "j", F.explode(sides).alias("s")).select("cluster", "i", "j", "s.block", "s.side")
    meet = meet.groupBy("cluster", "block").agg(F.collect_list(F.struct("i", "j", "side")).alias("meet"))
    placed = lookup_join(sets, blocks.select("sid", "block"), ["sid"])
    return lookup_join(placed, meet, ["cluster", "block"]).select(
        "cluster", "id", "items", F.explode("meet").alias("p")).select("cluster", "id", "items", "p.side", "p.i", "p.j")


def similar_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM,
                   num: int = NUM, den: int = DEN) -> DataFrame:
    """Per document: ``id_col``, ``n_shingles`` and ``component_id``, the least id that
    links of Jaccard >= num/den reach. Ids must be integers."""
    d = pick(docs, [id_col, text_col]).toDF("id", "text").select(F.col("id").cast("long").alias("id"), "text")
    spark = d.sparkSession
    ship_package(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed, path = pin_table(d.filter("id is not null").mapInArrow(_document_keys(n, num, den), "id bigint, keys binary"),
                            "near-keys", with_path=True)
    pilot = pin_table(connected_components(_key_links(keyed, parts, PILOT), "id", "least", shortened=True)
                      .filter("node != component").toDF("mid", "root"), "near-pilot")
    rooted = keyed.join(broadcast_if_small(pilot), F.col("id") == F.col("mid"), "left").select(
        F.coalesce("root", "id").alias("id"), "keys")
    links = _key_links(rooted, parts).unionByName(pilot.toDF("id", "least"))
    clusters = pin_table(connected_components(links, "id", "least", shortened=True)
                         .select(F.col("node").alias("mid"), F.col("component").alias("cluster")), "near-clusters")
    drop_files(spark, path)
    del rooted, links
    release_shuffles(spark)
    measured = pin_table(
        d.join(broadcast_if_small(clusters), F.col("id") == F.col("mid"), "left").select("id", "cluster", "text")
        .mapInArrow(_measure(n), "id bigint, cluster bigint, size bigint, digest binary"), "near-sizes")
    members = measured.filter("cluster is not null and size > 0")
    least = pin_table(members.groupBy("cluster", "digest", "size").agg(F.min("id").alias("rep")), "near-least")
    same = members.select("cluster", "digest", "size", "id").join(least, ["cluster", "digest", "size"])
    extent = pin_table(least.groupBy("cluster").agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("sets"))
                       .filter("sets > 1").select("cluster", "total"), "near-extents")
    reps = pin_table(lookup_join(least, extent, ["cluster"]).withColumnRenamed("rep", "id"), "near-reps")
    texts = lookup_join(d, reps.groupBy("id").agg(F.min("cluster").alias("cluster")), ["id"]).select("id", "cluster", "text")
    found = texts.mapInArrow(_collect_sets(n), "id bigint, cluster bigint, size bigint, digest binary, items binary")
    sets, path = pin_table(found.dropDuplicates(["cluster", "digest", "size", "id"])
                           .join(broadcast_if_small(reps), ["cluster", "digest", "size", "id"])
                           .select("cluster", "id", "size", "items", "total", F.monotonically_increasing_id().alias("sid")),
                           "near-sets", with_path=True)
    small, large = sets.filter(F.col("total") <= BLOCK_ITEMS), sets.filter(F.col("total") > BLOCK_ITEMS).drop("total")
    work = extent.filter(F.col("total") <= BLOCK_ITEMS).agg(F.sum("total")).first()[0] or 0
    bins = max(parts, -(-work // BLOCK_ITEMS))
    whole = F.lit(0)
    tasks = small.select("cluster", "id", "items", whole.alias("side"), whole.alias("i"), whole.alias("j"),
                         F.pmod(F.xxhash64("cluster"), F.lit(bins)).alias("bin"))
    able_path = None
    if large.limit(1).count():
        able, able_path = pin_table(_may_have_partner(large, parts, num, den), "near-able", with_path=True)
        release_shuffles(spark)
        tasks = tasks.unionByName(_block_tasks(able, num, den).withColumn("bin", -1 - F.pmod(F.col("cluster"), F.lit(1 << 62))))
    pairs = pin_table(tasks.groupBy("bin", "i", "j").applyInPandas(_verify(num, den), "a bigint, b bigint"), "near-links")
    drop_files(spark, path)
    if able_path:
        drop_files(spark, able_path)
    del tasks
    release_shuffles(spark)
    edges = pairs.union(same.filter("id != rep").select(F.col("id").alias("a"), F.col("rep").alias("b")))
    groups = connected_components(edges, "a", "b").withColumnsRenamed({"node": "nid", "component": "least"})
    return (measured.select("id", "size").join(broadcast_if_small(pin_table(groups, "near-groups")),
                                               F.col("id") == F.col("nid"), "left")
            .select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"),
                    F.coalesce("least", "id").alias("component_id")))
