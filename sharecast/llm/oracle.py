"""DuckDB forms of the corpus queries, written apart from the Spark plans: they
count, join and window over plain rows where the plans work inside arrays."""

from __future__ import annotations

from . import bm25_search, jaccard_join, license_scan, quality_rules, source_mix, url_filter
from .common import LOWER, UPPER

_LOWER = f"'{UPPER}', '{LOWER}'"
_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _values(rows) -> str:
    def one(v):
        return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else (
            str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'")
    return ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows)


CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
r AS (
  SELECT *, length('<|im_start|>') + length(role) + 2 * length(regexp_replace(role, '[^%<' || chr(10) || ']', '', 'g'))
      + 1 + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + length('<|im_end|>') + 1 AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM c),
s AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM r)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (WHERE role = 'assistant' OR back = 1) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""

LINES = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
x AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, {_TRIM}), {_LOWER}) AS key FROM x),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY doc_id
"""

_NGRAM, _NUM, _DEN = jaccard_join.NGRAM, jaccard_join.NUM, jaccard_join.DEN

#: Sets of shingles as texts (a word has no space in it), a self-join on equal shingles
#: that counts the common ones, and the reachable least id.
NEAR = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + {_NGRAM - 1}], ' ') AS gram
  FROM (SELECT *, unnest(range(1, greatest(len(words) - {_NGRAM - 1}, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS size FROM g GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (
  SELECT c.a, c.b FROM common c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b
  WHERE {_DEN} * c.shared >= {_NUM} * (x.size + y.size - c.shared)),
reach(doc_id, seen) AS (
  SELECT a, a FROM link UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.seen),
least AS (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.size, 0) AS n_shingles, coalesce(least.component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
"""

_BM = bm25_search

#: Term counts by words, a join of the asked terms with all documents, and the best of all.
SEARCH = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents WHERE doc_id IS NOT NULL),
x AS (SELECT doc_id, unnest(ws) AS w FROM d),
tf AS MATERIALIZED (SELECT doc_id, w, count(*) AS f FROM x GROUP BY ALL),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
n AS (SELECT count(*)::DOUBLE AS n, sum(len(ws))::DOUBLE / count(*)::DOUBLE AS mean FROM d),
q AS (SELECT tf.doc_id AS query_id, w, f * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS weight
  FROM tf JOIN df USING (w), n WHERE tf.doc_id % 100 = 0),
size AS (SELECT doc_id, len(ws)::DOUBLE AS size FROM d),
hit AS (SELECT query_id, tf.doc_id, sum(weight * f * {_BM.K1 + 1!r}::DOUBLE
      / (f + {_BM.K1}::DOUBLE * (1 - {_BM.B}::DOUBLE + {_BM.B}::DOUBLE * size / mean)) ORDER BY w) AS score
  FROM q JOIN tf USING (w) JOIN size USING (doc_id), n GROUP BY query_id, tf.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM hit)
SELECT query_id, rank, doc_id, round(score, {_BM.DIGITS}) AS score FROM ranked WHERE rank <= {_BM.K}
"""

URLS = f"""
WITH rules(host, path, verdict) AS (VALUES {_values(url_filter.QUERY_RULES)}),
p AS (SELECT page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), {_LOWER}) AS host,
    coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path FROM pages),
m AS (SELECT p.*, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST,
                       length(r.host) DESC, r.verdict DESC) AS n
  FROM p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1
"""

_M = source_mix
MIX = f"""
WITH d AS (SELECT doc_id, source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    (CAST('0x' || substr(md5('{_M.SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 13)
      AS BIGINT) + 0.5::DOUBLE) / {float(1 << 52)!r}::DOUBLE AS u FROM documents),
g AS (SELECT *, CAST(floor(1000 * size::DOUBLE / (size + {_M.HALF_WORDS})) AS BIGINT) AS g FROM d),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS words, CAST(sum(size * g) AS BIGINT) AS gwords FROM g GROUP BY source),
w AS (SELECT *, {list(_M.WEIGHTS)!r}[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(_M.WEIGHTS)}] AS weight,
    {_M.MAX_COPIES} * words AS cap FROM src),
t AS (SELECT sum(words) * {_M.BUDGET_PCT} AS t, sum(weight) AS k FROM w),
o AS (SELECT w.*, t, k,
    sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) - cap AS cap_before,
    sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) - weight AS w_before
  FROM w, t),
z AS (SELECT *, 100 * cap * (k - w_before) <= weight * (t - 100 * cap_before) AS sat FROM o),
q AS (SELECT coalesce(sum(cap) FILTER (WHERE sat), 0) AS c, coalesce(sum(weight) FILTER (WHERE sat), 0) AS wt FROM z),
plan AS (SELECT source, words, gwords, CASE WHEN sat THEN cap::DOUBLE
    ELSE (weight * (t - 100 * c))::DOUBLE / (100 * greatest(k - wt, 1))::DOUBLE END AS target FROM z, q),
par AS (SELECT *, CASE WHEN words > 0 THEN target / words END AS rate,
    gwords / (1000.0::DOUBLE * words) AS mean FROM plan),
par2 AS (SELECT *, CASE WHEN words > 0 AND rate > 0 THEN least({_M.TILT}::DOUBLE, greatest(0::DOUBLE,
    ({float(_M.MAX_COPIES)}::DOUBLE / rate - 1) / (1 - mean))) END AS tilt FROM par),
e0 AS (SELECT g.*, words, target, least({float(_M.MAX_COPIES)}::DOUBLE, greatest(0::DOUBLE,
    coalesce(rate * (1 + tilt * (g / 1000.0::DOUBLE - mean)), 0))) AS e
  FROM g JOIN par2 p ON g.source IS NOT DISTINCT FROM p.source),
e1 AS (SELECT *, CAST(floor(e) AS BIGINT) AS certain, e - floor(e) AS p FROM e0),
e2 AS (SELECT *, CASE WHEN p > 0 AND size > 0 THEN u / (1 - u) / (p / (1 - p)) END AS key FROM e1),
n AS (SELECT source, any_value(target) - sum(certain * size) AS need FROM e2 GROUP BY source),
run AS (SELECT e2.*, need, sum(size) OVER (PARTITION BY e2.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - size AS before
  FROM e2 JOIN n ON e2.source IS NOT DISTINCT FROM n.source WHERE key IS NOT NULL)
SELECT e2.doc_id, e2.size, e2.words AS source_size, e2.target,
  e2.size * (e2.certain + CASE WHEN run.before + e2.size / 2.0::DOUBLE <= run.need THEN 1 ELSE 0 END) AS taken
FROM e2 LEFT JOIN run ON e2.doc_id = run.doc_id
"""

_Q = quality_rules
QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, string_split(t, chr(10)) AS ls FROM d),
win AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - {_Q.WINDOW} + 2), lambda i: list_aggregate(ws[i:i + {_Q.WINDOW - 1}], 'string_agg', ' '))) AS s,
    unnest(range(1, len(ws) - {_Q.WINDOW} + 2)) AS i FROM w WHERE len(ws) > {_Q.WINDOW}),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, range({_Q.WINDOW}) AS r(k) WHERE n > 1 GROUP BY doc_id),
l0 AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM w),
l1 AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
    length(regexp_replace(line, '[^#*$%&<>]', '', 'g')) AS sym, length(regexp_replace(line, '[^!]', '', 'g')) AS bangs,
    length(regexp_replace(line, '[^|»›•]', '', 'g')) AS bars,
    length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars FROM l0),
l2 AS (SELECT *, n > 0 AND (sym * 2 > n OR (n >= 5 AND bangs * 10 > n * 3)
    OR (n >= {_Q.BARE_WORDS} AND NOT regexp_matches(line, '[.,;:!?"…。、{_Q.SCRIPT_MARKS}]'))
    OR (bars >= 3 AND bars * 5 > n)
    OR (n <= {_Q.BOILERPLATE_WORDS} AND regexp_matches(lower(line), '{"|".join(_Q.BOILERPLATE)}'))) AS fails FROM l1),
l3 AS (SELECT doc_id, CAST(count(*) FILTER (WHERE n > 0) - count(DISTINCT line) FILTER (WHERE n > 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(sum(chars) FILTER (WHERE fails), 0) AS BIGINT) AS lost_chars FROM l2 GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, lost_chars
  FROM w JOIN l3 USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT *, n_words < {_Q.MIN_WORDS} OR 100 * n_repeat_words > {_Q.MAX_REPEAT_PCT} * n_words AS base_failed,
  NOT (n_words < {_Q.MIN_WORDS} OR 100 * n_repeat_words > {_Q.MAX_REPEAT_PCT} * n_words)
    AND 100 * lost_chars <= {_Q.MAX_LOST_PCT} * word_chars AS kept
FROM m
"""

_T = license_scan._index_rows()
_TW = [(t, base, label, j, w, len(ws), need, a <= j < b, b - a)
       for t, (base, label, ws, need, a, b) in enumerate(_T) for j, w in enumerate(ws)]
LICENSES = rf"""
WITH tw(t, base, label, j, w, n, need, must, n_must) AS (VALUES {_values(_TW)}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
x AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM d),
hit AS (SELECT x.doc_id, tw.t, x.i - tw.j AS start, count(*) AS same, count(*) FILTER (WHERE tw.must) AS same_must
  FROM x JOIN tw USING (w) GROUP BY ALL),
ok AS (SELECT DISTINCT hit.doc_id, hit.t, tw.base, tw.label, start, same::DOUBLE / tw.n AS share
  FROM hit JOIN tw ON tw.t = hit.t WHERE same >= need AND same_must = n_must),
per AS (SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word,
    max(start) FILTER (WHERE base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM ok GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0::DOUBLE) AS score
FROM d LEFT JOIN per USING (doc_id)
"""

PHRASES = rf"""
WITH p AS (SELECT doc_id, coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), {_LOWER}), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
n AS (SELECT lang, CAST(sum(len(ws)) AS HUGEINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, ws[i:i + k - 1] AS g FROM w, range(1, 6) AS r(k), range(1, len(ws) - k + 2) AS s(i)),
f AS MATERIALIZED (SELECT lang, g, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, g, f AS a FROM f WHERE len(g) > 1),
inner_of AS (SELECT DISTINCT q.lang, q.g[i:i + k - 1] AS g, q.a FROM c q, range(2, 5) AS r(k), range(1, len(q.g) - k + 2) AS s(i)
  WHERE k < len(q.g)),
cut AS (SELECT c.lang, c.g, c.a, k, l.f AS l, r.f AS r, n.n, 1000::HUGEINT * c.a * n.n // (l.f::HUGEINT * r.f) AS score
  FROM c, range(1, 5) AS t(k) JOIN f l ON l.lang = c.lang AND l.g = c.g[1:k] JOIN f r ON r.lang = c.lang AND r.g = c.g[k + 1:]
    JOIN n ON n.lang = c.lang WHERE k < len(c.g)),
low AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS nth FROM cut),
stay AS (SELECT low.* FROM low LEFT JOIN inner_of i ON i.lang = low.lang AND i.g = low.g AND i.a = low.a
  WHERE nth = 1 AND i.g IS NULL),
ranked AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score,
    row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(g, ' '))) AS rank FROM stay)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""

COPIES = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d
"""


def _tree_sql(prefix: str, source: str, levels: int) -> str:
    """Tables {prefix}0.. of (g, pos, n, node) per level and {prefix}_paths (g, pos, sib)
    with the siblings of every leaf; runs of two, as long as a group has several nodes."""
    steps = [f"{prefix}0 AS MATERIALIZED ({source})"]
    sibs = []
    for i in range(levels):
        steps.append(f"""{prefix}{i + 1} AS MATERIALIZED (
  SELECT g, pos // 2 AS pos, any_value((n + 1) // 2) AS n, sha256(string_agg(node, '' ORDER BY pos)) AS node
  FROM {prefix}{i} WHERE n > 1 GROUP BY g, pos // 2 UNION ALL SELECT * FROM {prefix}{i} WHERE n = 1)""")
        sibs.append(f"""SELECT l.g, l.pos, {i} AS level, s.node, s.pos % 2 = 0 AS is_left FROM {prefix}0 l JOIN {prefix}{i} s
    ON l.g = s.g AND s.n > 1 AND s.pos = xor(l.pos >> {i}, 1)""")
    steps.append(f"{prefix}_sib AS MATERIALIZED (" + "\n  UNION ALL ".join(sibs) + ")")
    return ",\n".join(steps)


def _fold_sql(leaf: str, sibs: str) -> str:
    return (f"list_reduce({sibs}, lambda acc, s: {{'v': sha256(CASE WHEN s.v = '' THEN acc.v WHEN s.is_left "
            f"THEN s.v || acc.v ELSE acc.v || s.v END), 'is_left': false}}, {{'v': {leaf}, 'is_left': false}}).v")


#: Levels that the SQL writes out: groups of up to 2 ** 18 rows and 2 ** 6 groups.
_DEEP, _WIDE = 18, 6
_ENC = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode(CAST({0} AS VARCHAR))) || ':' || {0} END"
_LEAF = "sha256(" + " || ".join(_ENC.format(c) for c in ("doc_id", "source", "lang", "{n_chars}", "text")) + ")"
_CRC = """xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda crc, b: list_reduce([0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END),
    xor(crc, b)), 4294967295::BIGINT), 4294967295::BIGINT)"""
MERKLE = f"""
WITH d AS MATERIALIZED (SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS g,
    {_LEAF.format(n_chars="n_chars")} AS leaf, {_LEAF.format(n_chars="(n_chars + 1)")} AS longer,
    {_CRC} % 7 = 0 AS hit FROM documents),
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY g) AS n FROM d),
{_tree_sql("t", "SELECT g, pos, n, leaf AS node FROM r", _DEEP)},
sub AS MATERIALIZED (SELECT g, node, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS n FROM t{_DEEP}),
{_tree_sql("u", "SELECT '' AS g, pos, n, node FROM sub", _WIDE)},
up AS MATERIALIZED (SELECT sub.g, u{_WIDE}.node AS root FROM sub, u{_WIDE}),
steps AS (SELECT r.g, r.pos, i.i AS level FROM r, (SELECT unnest(range({_DEEP})) AS i) i WHERE r.n > (1 << i.i)
  UNION ALL SELECT r.g, r.pos, 100 + i.i FROM r JOIN sub ON r.g = sub.g, (SELECT unnest(range({_WIDE})) AS i) i WHERE sub.n > (1 << i.i)),
sib AS (SELECT * FROM t_sib UNION ALL
  SELECT r.g, r.pos, 100 + s.level, s.node, s.is_left FROM r JOIN sub ON r.g = sub.g JOIN u_sib s ON s.pos = sub.pos),
path AS (SELECT g, pos, list({{'v': coalesce(sib.node, ''), 'is_left': coalesce(sib.is_left, false)}} ORDER BY level) AS p
  FROM steps LEFT JOIN sib USING (g, pos, level) GROUP BY g, pos),
x AS (SELECT r.doc_id, r.leaf, t{_DEEP}.node AS subroot, up.root, coalesce(path.p, []) AS p,
    CASE WHEN hit THEN longer ELSE leaf END AS seen
  FROM r JOIN t{_DEEP} ON r.g = t{_DEEP}.g JOIN up ON r.g = up.g LEFT JOIN path ON r.g = path.g AND r.pos = path.pos),
f AS (SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(p, lambda s: s.v), '')) AS proof_sha256,
    {_fold_sql("seen", "p")} AS folded_root FROM x)
SELECT *, folded_root = root AS verified FROM f
"""

ORACLE_SQL = {
    "op1_chat_format": CHAT,
    "op2_line_dedup": LINES,
    "op3_url_filter": URLS,
    "op9_jaccard_join": NEAR,
    "op4_source_mix": MIX,
    "op5_bm25_search": SEARCH,
    "op6_quality_rules": QUALITY,
    "op10_license_scan": LICENSES,
    "op11_phrase_mining": PHRASES,
    "op12_merkle_manifest": MERKLE,
    "op13_exact_dedup": COPIES,
}
