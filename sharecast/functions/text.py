"""Page and JSON text expressions: first-script metadata, JSON fields, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How a page's metadata record is located — the body of the first
# <script> element, its first statement (up to ';'), the text after the first
# '=' of that statement (up to a second '=').
FIRST_SCRIPT_PATTERN = r"(?si)<script\b[^>]*>(.*?)</script>"
STATEMENT_SEPARATOR = ";"
ASSIGNMENT_SEPARATOR = "="
PUB_DATE_FORMAT = "MM/dd/yyyy"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def first_script(html) -> Column:
    """Body of the first <script> element ('' when there is none)."""
    return F.regexp_extract(_c(html), FIRST_SCRIPT_PATTERN, 1)


def first_statement(text) -> Column:
    return F.get(F.split(_c(text), STATEMENT_SEPARATOR), 0)


def assigned_text(statement) -> Column:
    """Text between the first and the second '=' (NULL when there is no '=')."""
    return F.get(F.split(_c(statement), ASSIGNMENT_SEPARATOR), 1)


def common_indent(lines: Column) -> Column:
    """The longest run of blanks that all lines with text start with."""
    heads = F.transform(F.filter(lines, lambda x: x.rlike(r"[^ \t\r]")),
                        lambda x: F.regexp_extract(x, r"^[ \t]*", 0))
    lo, hi = F.coalesce(F.array_min(heads), F.lit("")), F.coalesce(F.array_max(heads), F.lit(""))
    same = F.filter(F.sequence(F.lit(0), F.length(lo)), lambda n: F.substring(hi, F.lit(1), n) == F.substring(lo, F.lit(1), n))
    return F.array_max(same)


def strip_indent(text) -> Column:
    """Remove the common indentation of the record's lines; deeper lines keep the rest
    of theirs, lines of blanks become empty."""
    lines = F.split(_c(text), "\n", -1)
    # the indent is found once per record: bound as a lambda variable, not a call per line
    return F.transform(F.array(common_indent(lines)), lambda indent: F.array_join(F.transform(lines, lambda x: F.when(
        x.rlike(r"[^ \t\r]"), F.substring(x, indent + 1, F.lit(2147483647))).otherwise(F.lit(""))), "\n"))[0]


def _unquoted(x: Column) -> Column:
    return F.regexp_replace(F.trim(x), r"""^(["'])(.*)\1$""", "$2")


def _last_wins(entries: Column) -> Column:
    """A map of (key, value) entries; of equal keys the last one counts."""
    return F.map_from_entries(F.filter(entries, lambda e, i: ~F.exists(
        F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"])))


def _entries(parts: Column) -> Column:
    return F.transform(parts, lambda p: F.struct(
        _unquoted(F.regexp_extract(p, r"(?s)^\s*([^:]+):", 1)).alias("key"),
        _unquoted(F.regexp_extract(p, r"(?s)^[^:]*:(.*)$", 1)).alias("value")))


def record_map(text) -> Column:
    """The record as map<string,string>; NULL when it is not a mapping.

    Strict JSON objects, objects with unquoted or single-quoted names, flat
    ``{name: value, ...}`` records with bare values, and ``name: value`` lines."""
    t = F.trim(_c(text))
    strict = F.from_json(t, "map<string,string>", {"allowUnquotedFieldNames": "true", "allowSingleQuotes": "true"})
    body = F.regexp_extract(t, r"(?s)^\{([^{}\[\]]*)\}$", 1)
    flow = F.when(body.rlike(r"(?s)^\s*[^:,]+:[^,]*(,\s*[^:,]+:[^,]*)*$"), _last_wins(_entries(F.split(body, ","))))
    rows = F.filter(F.split(t, r"\r?\n"), lambda x: F.trim(x) != F.lit(""))
    is_lines = (F.size(rows) > 0) & F.forall(rows, lambda x: x.rlike(r"^[A-Za-z_][\w .-]*:(\s.*)?$"))
    return F.coalesce(strict, flow, F.when(is_lines, _last_wins(_entries(rows))))


def _json_text(text) -> Column:
    """A record as JSON text: names and values without quotes (all but numbers, true,
    false and null) and in single quotes get double ones; quoted strings stay."""
    quoted = r'"(?:[^"\\\\]|\\\\.)*"'
    # single to double quotes, outside strings in double quotes
    t = F.regexp_replace(F.trim(_c(text)), rf"({quoted})|'([^'\"]*)'", "$1\u0001$2\u0001")
    t = F.regexp_replace(t, rf"({quoted})\u0001\u0001", "$1")
    t = F.regexp_replace(t, "\u0001([^\u0001]*)\u0001", '"$1"')
    bare = r"(?!(?:true|false|null)\s*[,:}\]]|-?[0-9][0-9.eE+-]*\s*[,}\]])[^\s\"{}\[\],:][^\"{}\[\],:]*?"
    t = F.regexp_replace(t, rf"({quoted})|(?<=[{{\[,:\s])({bare})(?=\s*[,:}}\]])", "$1\u0001$2\u0001")
    t = F.regexp_replace(t, rf"({quoted})\u0001\u0001", "$1")
    return F.regexp_replace(t, "\u0001([^\u0001]*)\u0001", '"$1"')


def record_variant(text) -> Column:
    """The record as a VARIANT, nested lists and objects included; NULL when it is no
    object or list. Strict JSON, or names and values that are bare or in single quotes
    (``{topics: [a, b], place: {city: Oslo}}``)."""
    strict = F.try_parse_json(F.trim(_c(text)))
    v = F.coalesce(strict, F.try_parse_json(_json_text(text)))
    return F.when(F.trim(_c(text)).rlike(r"(?s)^[\[{].*[\]}]$"), v)


def scalar_value(text) -> Column:
    """A quoted scalar record without its quotes, else the trimmed text."""
    t = F.trim(_c(text))
    return F.when(t.rlike(r'^"[^"]*"$'), F.regexp_extract(t, r'^"([^"]*)"$', 1)).otherwise(t)


def json_array_field(reply, field: str) -> Column:
    """Field of the first object of a JSON array reply (bigint)."""
    parsed = F.from_json(_c(reply), f"array<struct<`{field}`:bigint>>")
    return F.get(parsed, 0)[field]


def json_object_field(reply, field: str) -> Column:
    """Field of a JSON object reply (bigint)."""
    return F.get_json_object(_c(reply), f"$.{field}").cast("bigint")


def pub_date_text(ts) -> Column:
    return F.date_format(_c(ts), PUB_DATE_FORMAT)


def age_days(pub_date, as_of: str) -> Column:
    """Whole days from a 'MM/dd/yyyy' publication date to the as-of date."""
    return F.datediff(F.lit(as_of).cast("date"),
                      F.to_date(_c(pub_date), PUB_DATE_FORMAT)).cast("bigint")
