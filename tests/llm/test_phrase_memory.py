"""Phrases and words counted in bounded memory."""

import random
import tracemalloc

import numpy as np

from sharecast.llm import phrase_mining


def test_a_flush_of_phrases_takes_little_memory():
    counter, draw, out = phrase_mining._Counter(), np.random.default_rng(2), []
    tracemalloc.start()
    while not out:
        x = draw.integers(0, 1 << 40, 100_000).astype(np.uint64)
        out += counter.add(2, x, x.copy(), x.copy(), x.copy())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6 and sum(b.num_rows for b in out) > 0


def test_words_counted_in_parts_add_up(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(phrase_mining, "CHUNK_BYTES", 40)
    monkeypatch.setattr(phrase_mining, "VOCABULARY", 6)
    monkeypatch.setattr(phrase_mining, "WORD_ROWS", 4)
    draw = random.Random(3)
    rows = [(draw.choice("xy"), " ".join(draw.choice("abcdefghijkl") for _ in range(12))) for _ in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["lang", "text"])
    got, sizes = {}, []
    for b in phrase_mining._encode(0)([batch]):
        words = [r for r in b.to_pylist() if r["lang"] is not None]
        sizes.append(len(words))
        for r in words:
            got[r["lang"], r["word"]] = got.get((r["lang"], r["word"]), 0) + r["n"]
    want = {}
    for lang, text in rows:
        for w in text.split():
            want[lang, w] = want.get((lang, w), 0) + 1
    assert got == want and max(sizes) <= 4
