"""Byte-pair encoding and decoding by longest tokens with backtracking.

A row of tokens is the encoding of its bytes exactly if every two neighbours are
compatible, that is, if merging the two tokens' bytes would leave exactly this pair; so
there is one such row. It is searched from the left: the longest token that a trie of the
vocabulary finds comes next if it is compatible with the one before it, else the next
shorter one. Where none is, the token before is taken back and that position is marked as
one that no encoding reaches, so every position is given up once at most: the very ids
that merging by rank gives, in time linear in the text.

Two tokens are compatible unless a merge crosses their border: a right-edge part x of
the first and a left-edge part y of the second merge at a rank before either part is
used up inside its own token (of equal ranks the left one is merged first).

Texts are split at added tokens, then by the byte-level pre-tokenizer's pattern.
Encodings of pre-tokens and of space-separated chunks are kept in caches of
``CACHE`` entries, emptied when full. The vocabulary file is read on the driver and
broadcast (its size is fixed); each Python worker builds the trie once. There is
no shuffle: a document is encoded where it is read.

Defined cases: a null or empty text has no ids; repeated rows are encoded alike; texts
of any length are encoded whole; ids that the vocabulary lacks are skipped when
decoding; an empty table gives no rows; other columns are ignored, but for ``keep``.
"""

from __future__ import annotations

import json
import re
import sys
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, sha256_hex, ship_package

CACHE = 150_000
CACHED_CHARS = 64
ROWS_AT_ONCE = 500
MARKS = frozenset(".,;:!?")

# Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\t-\r\x85\p{Z}\p{L}\p{N}]+"
           r"|[\t-\r\x85\p{Z}]+(?![^\t-\r\x85\p{Z}])|[\t-\r\x85\p{Z}]+")


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the byte-level vocabulary and their bytes: Latin-1's
    visible characters stand for themselves, the rest are numbered from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Decoder:
    """The bytes of every id."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        alphabet = byte_alphabet()
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {i: bytes(alphabet[ch] for ch in tok)
                         for tok, i in spec["model"]["vocab"].items() if tok not in self.added}
        self.bytes_of |= {i: text.encode() for text, i in self.added.items()}

    def decode(self, ids: bytes) -> str:
        get = self.bytes_of.get
        return b"".join([get(i, b"") for i in unpack(ids)]).decode("utf-8", "replace")


class Encoder(Decoder):
    """One vocabulary: token tables, the trie, and caches."""

    def __init__(self, content: bytes, cache: int = CACHE):
        import ahocorasick
        import regex

        super().__init__(content)
        spec = json.loads(content)
        model = spec["model"]
        if model["type"] != "BPE" or spec.get("normalizer") or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("a byte-level BPE vocabulary without normalizer and prefix space is expected")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", [])):
            raise ValueError("added tokens that strip or match whole words are not supported")
        self.split_added = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))
                                      + ")").split if self.added else None
        own = set(self.added.values())
        ids = {text: i for i, text in self.bytes_of.items() if i not in own}
        named = {tok: i for tok, i in model["vocab"].items() if i not in own}
        self.rank: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = (named[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            made = ids[self.bytes_of[a] + self.bytes_of[b]]
            if made in parts:
                raise ValueError("a token is made by two merges")
            self.rank[a, b], parts[made] = r, (a, b, r)
        never = len(model["merges"])
        del spec, model, named
        self.right, self.left = {}, {}
        for i in sorted(ids.values()):
            self.right[i] = self._edge(i, parts, 1, never)
            self.left[i] = self._edge(i, parts, 0, never)
        self.fits: dict[int, bool] = {}
        self.limit = cache
        self.trie = ahocorasick.Automaton()
        self.number: dict[str, int] = {}         # tokens that merging makes
        self.packed: dict[str, bytes] = {}       # their packed ids
        for text, i in ids.items():
            if i not in parts or not self._crossed(*parts[i][:2], before=parts[i][2]):
                name = text.decode("latin-1")
                self.number[name], self.packed[name] = i, pack([i])
                self.trie.add_word(name, i)
        self.longest = max(map(len, self.number), default=0)
        self.pieces_of = regex.compile(PATTERN).findall
        self.loose_space = re.compile(r" (?:\s|\Z)").search
        self.pieces = _Cache(self._piece, cache)
        self.chunks = _Cache(self._spaced, cache)

    @staticmethod
    def _edge(i: int, parts: dict, side: int, never: int) -> list[tuple[int, int]]:
        """The token and its nested parts at one edge, each with the rank that uses it up."""
        out, used = [(i, never)], never
        while i in parts:
            used, i = parts[i][2], parts[i][side]
            out.append((i, used))
        return out

    def _crossed(self, a: int, b: int, before: int | None = None) -> bool:
        """Whether a merge crosses the border of tokens a and b (earlier than ``before``)."""
        for x, used_x in self.right[a]:
            for y, used_y in self.left[b]:
                m = self.rank.get((x, y))
                if m is not None and m < used_x and m <= used_y and (before is None or m < before):
                    return True
        return False

    def _meets(self, a: int, b: int) -> bool:
        """Whether tokens a and b are compatible; kept in ``fits``."""
        if len(self.fits) >= self.limit:
            self.fits.clear()
        known = self.fits[a << 32 | b] = not self._crossed(a, b)
        return known

    def _piece(self, piece: str) -> bytes:
        """Ids of one pre-token, packed."""
        text = piece if piece.isascii() else piece.encode().decode("latin-1")
        if text in self.packed:
            return self.packed[text]
        fits, number, prefix, longest = self.fits, self.number, self.trie.longest_prefix, self.longest
        out, starts, dead = [], [], set()        # tokens and their starts; ends that lead nowhere
        at, size, end = 0, 0, len(text)
        while at < end:
            size = size or prefix(text[at:at + longest])
            while size:
                token = number.get(text[at:at + size])
                if token is not None and at + size not in dead:
                    if not out:
                        break
                    known = fits.get(out[-1] << 32 | token)
                    if self._meets(out[-1], token) if known is None else known:
                        break
                size -= 1
            if size:
                out.append(token)
                starts.append(at)
                at, size = at + size, 0
                continue
            if not out:
                raise ValueError("the vocabulary cannot spell a text")
            dead.add(at)                         # take the last token back, go on with shorter ones
            out.pop()
            size, at = at - starts[-1], starts.pop()
        return pack(out)

    def _chunk(self, chunk: str) -> bytes:
        return b"".join([self.pieces[p] for p in self.pieces_of(chunk)])

    def _spaced(self, part: str) -> bytes:
        """The chunk of a space and ``part``; a plain word, with a mark at its end or
        without, needs no pattern to be split."""
        if part.isascii():
            if part.isalpha():
                return self.pieces[" " + part]
            if part[-1:] in MARKS and part[:-1].isalpha():
                return self.pieces[" " + part[:-1]] + self.pieces[part[-1]]
        return self._chunk(" " + part)

    def _plain(self, text: str) -> bytes:
        """A text without added tokens. A space before a character that is not white
        space always starts a pre-token, so texts are looked up chunk by chunk."""
        parts = text.split(" ")
        if not self.loose_space(text):
            return self._chunk(parts[0]) + b"".join(map(self.chunks.__getitem__, parts[1:]))
        joined = [[parts[0]]]
        for part in parts[1:]:
            if part and not part[0].isspace():
                joined.append([part])
            else:
                joined[-1].append(part)
        out = [self._chunk(" ".join(joined[0]))]
        out += [self.chunks[" ".join(j)] for j in joined[1:]]
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a text, packed as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.split_added or not any(t in text for t in self.added):
            return self._plain(text)
        return b"".join(pack([self.added[s]]) if s in self.added else self._plain(s)
                        for s in self.split_added(text) if s)


class _Cache(dict):
    """Values made on first use; emptied when ``limit`` is reached; long keys are not kept."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) <= CACHED_CHARS:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


def pack(ids) -> bytes:
    a = array("I", ids)
    if a.itemsize != 4:
        a = array("L", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


def unpack(data: bytes) -> array:
    a = array("I", data)
    if sys.byteorder == "big":
        a.byteswap()
    return a


_built: dict[tuple, Decoder] = {}


def _shared(kind: type, content: bytes) -> Decoder:
    """This worker's encoder or decoder of a vocabulary."""
    key = kind.__name__, hash(content)
    if key not in _built:
        _built.clear()
        _built[key] = kind(content)
    return _built[key]


def _slices(batches):
    """Batches in pieces of a few rows, so that few texts are Python objects at a time."""
    for b in batches:
        for i in range(0, b.num_rows, ROWS_AT_ONCE):
            yield b.slice(i, ROWS_AT_ONCE)


def _content(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_texts(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text",
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``keep`` and ``ids`` (packed little-endian unsigned 32-bit integers)
    of every document; ``vocabulary`` is the path of a byte-level BPE file."""
    import pyarrow as pa

    d = pick(docs, [id_col, *keep, text_col])
    ship_package(d.sparkSession)
    shared = d.sparkSession.sparkContext.broadcast(_content(vocabulary))

    def run(batches):
        encode = _shared(Encoder, shared.value).encode
        for b in _slices(batches):
            ids = pa.array([encode(t) for t in b.column(b.num_columns - 1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], ids], [*b.schema.names[:-1], "ids"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[:-1]]
    return d.mapInArrow(run, ", ".join([*fields, "ids binary"]))


def decode_ids(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``encoded`` with the column ``text`` decoded from ``ids``."""
    import pyarrow as pa

    rest = [c for c in encoded.columns if c != "ids"]
    e = encoded.select(*rest, "ids")
    ship_package(e.sparkSession)
    shared = e.sparkSession.sparkContext.broadcast(_content(vocabulary))

    def run(batches):
        decode = _shared(Decoder, shared.value).decode
        for b in _slices(batches):
            texts = pa.array([decode(x) for x in b.column(b.num_columns - 1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], [*b.schema.names, "text"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in e.schema.fields]
    return e.mapInArrow(run, ", ".join([*fields, "text string"]))


def token_digests(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), sha256_hex(F.col("text")).alias("decoded_sha256"))
