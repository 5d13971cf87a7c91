"""Plain Python versions of the corpus operators, for tests."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def sha(x) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def dedup_lines(rows, min_docs=10):
    """[(id, text)] -> [(id, kept text, lines, dropped)]"""
    def key(line):
        return lower(line.strip(" \t\n\x0b\x0c\r"))

    found = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            found[key(line)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or len(found[key(x)]) < min_docs]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def line_fails(line):
    from sharecast.llm import quality_rules as Q

    PUNCTUATION = '[.,;:!?"…。、' + re.sub(r"\\x\{(\w+)\}", lambda m: f"\\U{int(m[1], 16):08x}", Q.SCRIPT_MARKS) + "]"

    n = len(WORD.findall(line))
    if not n:
        return False
    def count(chars):
        return sum(c in chars for c in line)
    bars = count("|»›•")
    return (count("#*$%&<>") * 2 > n or (n >= 5 and count("!") * 10 > n * 3)
            or (n >= Q.BARE_WORDS and not re.search(PUNCTUATION, line))
            or (bars >= 3 and bars * 5 > n)
            or (n <= Q.BOILERPLATE_WORDS and any(p in line.lower() for p in Q.BOILERPLATE)))


def quality(text):
    """(cleaned text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)"""
    t = text or ""
    w = WORD.findall(t)
    chars = sum(map(len, w))
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if seen[tuple(w[i:i + 8])] > 1 for k in range(8)}
    clean = "\n".join(x for x in t.split("\n") if not line_fails(x))
    lost = chars - sum(map(len, WORD.findall(clean)))
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return (clean, len(w), chars, sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered),
            failed, not failed and 100 * lost <= 50 * chars)


def shingles(text, n=3):
    w = WORD.findall(lower(text))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(rows, num=90, den=100, n=3):
    """[(id, text)] -> {id: component} (ids may repeat)"""
    sets = [(d, shingles(t, n)) for d, t in rows if d is not None]
    up = {d: d for d, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, u in sets[:i]:
            if s and u and den * len(s & u) >= num * len(s | u):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: root(d) for d in up}


def repeats(rows, length=100):
    """[(id, bytes)] in document order -> {id: (bytes, removed, spans, digest of the rest)}"""
    seen, out = set(), {}
    for d, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            w = t[i:i + length]
            if w in seen:
                gone[i:i + length] = b"\x01" * length
            seen.add(w)
        spans = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(t)))
        out[d] = (len(t), sum(gone), spans, sha(bytes(c for c, g in zip(t, gone, strict=True) if not g)))
    return out


def bm25(rows, query, k=10):
    """[(id, text)], query text -> [(id, score)] best first"""
    docs = [(d, Counter(ALNUM.findall(lower(t)))) for d, t in rows if d is not None]
    df = Counter(w for _, c in docs for w in c)
    n, mean = len(docs), sum(sum(c.values()) for _, c in docs) / max(len(docs), 1)
    asked, out = Counter(ALNUM.findall(lower(query))), []
    for d, c in docs:
        size = sum(c.values())
        x = sum(m * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (
            c[w] + 1.2 * (0.25 + 0.75 * size / mean)) for w, m in asked.items() if w in c)
        if x > 0:
            out.append((d, x))
    return sorted(out, key=lambda z: (-z[1], z[0]))[:k]


def copies(rows):
    """[(id, text)] -> [(id, keep_id, size, digest)], ids null last"""
    text = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = defaultdict(list)
    for (d, _), t in zip(rows, text, strict=True):
        groups[t].append(d)
    least = {t: min((d for d in ids if d is not None), default=None) for t, ids in groups.items()}
    return [(d, least[t], len(groups[t]), sha(t)) for (d, _), t in zip(rows, text, strict=True)]


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def merkle(rows, k=2):
    """[(id, group, leaf)] -> ({(id, leaf): (subroot, path)}, root); path as [(left, right)]"""
    def climb(leaves):
        paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
        while len(level) > 1:
            for p, i in zip(paths, at, strict=True):
                run = level[i - i % k:i - i % k + k]
                p.append(("".join(run[:i % k]), "".join(run[i % k + 1:])))
            at = [i // k for i in at]
            level = [sha("".join(level[i:i + k])) for i in range(0, len(level), k)]
        return level[0], paths

    groups = defaultdict(list)
    for d, g, leaf in rows:
        groups[g].append(((d is not None, d or 0), leaf, d))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([x[1] for x in sorted(groups[g], key=lambda x: x[:2])]) for g in order}
    root, upper = climb([trees[g][0] for g in order])
    out = {}
    for g, above in zip(order, upper, strict=True):
        for x, p in zip(sorted(groups[g], key=lambda x: x[:2]), trees[g][1], strict=True):
            out[x[2], x[1]] = (trees[g][0], p + above)
    return out, root


def phrases(rows, min_count=100, top=2000, longest=5):
    """[(lang, text)] -> {(lang, rank, phrase, a, l, r, n, score)}"""
    total, f = Counter(), defaultdict(Counter)
    pieces = [(lang or "und", re.findall(r"[^\x20\x09]+", p)) for lang, t in rows
              for p in re.split(r"[.,;:!?\x0A-\x0D]", lower(t))]
    for lang, w in pieces:
        total[lang] += len(w)
    for k in range(1, longest + 1):
        for lang, w in pieces:
            for i in range(len(w) - k + 1):
                if k == 1 or (" ".join(w[i:i + k - 1]) in f[lang] and " ".join(w[i + 1:i + k]) in f[lang]):
                    f[lang][" ".join(w[i:i + k])] += 1
        for lang in f:
            f[lang] = Counter({p: c for p, c in f[lang].items() if c >= min_count})
    out = set()
    for lang, counts in f.items():
        inside = {(" ".join(w[i:i + k]), a) for p, a in counts.items() for w in [p.split(" ")]
                  for k in range(1, len(w)) for i in range(len(w) - k + 1)}
        found = []
        for p, a in counts.items():
            w = p.split(" ")
            if len(w) > 1 and (p, a) not in inside:
                cuts = [(counts[" ".join(w[:k])], counts[" ".join(w[k:])]) for k in range(1, len(w))]
                score, _, lr = min((1000 * a * total[lang] // (x * y), k, (x, y)) for k, (x, y) in enumerate(cuts))
                found.append((-score, -a, p.encode(), *lr))
        out |= {(lang, i + 1, p.decode(), -a, x, y, total[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top])}
    return out
