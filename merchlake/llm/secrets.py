"""Secret scans: keyword automaton, anchored patterns near its hits, then embedded checksums.

One Aho-Corasick pass over the lower-cased text finds every keyword. A pattern is tried only at the start of
a hit, never searched for, so its cost follows the hits and not the text. Bare hexadecimal runs have no
keyword and are scanned as runs. Tokens that carry a CRC-32 in their last six base-62 digits count only if it
fits. Offsets are code points, ends exclusive. Null text is empty and holds nothing, equal texts give
equal spans, other columns pass through `redact`, and an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_batch

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "forge", "package")
_ORDER = {k: i for i, k in enumerate(KINDS)}
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_FORGE = re.compile(r"(gh[pousr]_)([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_PACKAGE = re.compile(r"(npm_)([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "forge": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "package": ("npm_",),
}
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_LOWER = {c: c + 32 for c in range(65, 91)}


@cache
def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for kind, words in _KEYWORDS.items():
        for word in words:
            out.add_word(word, (kind, len(word)))
    out.make_automaton()
    return out


def _lowered(text: str) -> str:
    """Lower case with every offset kept."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_LOWER)


def base62(n: int, width: int) -> str:
    out = ""
    while n:
        n, r = divmod(n, 62)
        out = _DIGITS[r] + out
    return out.rjust(width, "0")


def checksum_fits(m: re.Match) -> bool:
    return base62(zlib.crc32(m[2].encode()), 6) == m[3]


_RULES = {
    "assign": (_ASSIGN, lambda m: len(m[2]) >= 12),
    "access": (_ACCESS, lambda m: len(m[0]) >= 18),
    "forge": (_FORGE, checksum_fits),
    "package": (_PACKAGE, checksum_fits),
}


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every secret by start and then kind; matches of one kind do not overlap."""
    if not text:
        return []
    hits: dict[str, list[int]] = {}
    for end, (kind, size) in _automaton().iter(_lowered(text)):
        hits.setdefault(kind, []).append(end + 1 - size)
    found = []
    for kind, starts in hits.items():
        pattern, fits = _RULES[kind]
        free = 0
        for at in sorted(starts):
            if at >= free and (m := pattern.match(text, at)):
                free = m.end()
                if fits(m):
                    found.append((kind, at, free))
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], _ORDER[x[0]]))


def redacted(text: str | None, mark: str = "[{}]") -> str | None:
    """The text with each span replaced by its kind; overlapping spans become one."""
    spans = scan(text)
    if not spans:
        return text
    out, at, open_end = [], 0, -1
    for kind, start, end in spans:
        if start >= open_end:
            out += [text[max(at, 0) : start], mark.format(kind)]
        open_end = at = max(open_end, end)
    return "".join(out) + text[at:]


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def spans(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: the key and its spans."""
    schema = f"`{key}` {dict(df.dtypes)[key]}, spans array<struct<kind:string,start:bigint,end:bigint>>"

    def find(batch: pa.RecordBatch) -> list:
        texts = (x.as_py() for x in batch.column(1))
        return [(k, [{"kind": a, "start": b, "end": c} for a, b, c in scan(t)]) for k, t in zip(batch.column(0).to_pylist(), texts, strict=True)]

    return by_batch(df.select(key, text), find, schema)


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the secrets of its texts replaced by their kinds in brackets."""

    def change(batch: pa.RecordBatch) -> dict:
        own = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        return own | {text: [redacted(x.as_py()) for x in own[text]]}

    return by_batch(df, change, ", ".join(f"`{n}` {t}" for n, t in df.dtypes))


def op8_secrets(documents: DataFrame) -> DataFrame:
    """Every document's secrets: counts and a digest of the base kinds, and all spans."""
    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"

    def describe(batch: pa.RecordBatch) -> list:
        rows = []
        for key, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            every = [(x["kind"], x["start"], x["end"]) for x in found]
            base = [x for x in every if x[0] in KINDS[:3]]
            counts = [sum(x[0] == k for x in base) for k in KINDS[:3]]
            rows.append((key, *counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every)))
        return rows

    return by_batch(spans(documents), describe, schema)


def _spans_sql(kind: str, pattern: str, fits: str) -> str:
    """SQL for the matches of a pattern (with {1} for the whole match) that fit: every match is put between two marks, and the lengths of what
    stands before add up to its place."""
    return f"""SELECT r, '{kind}' AS kind, pos, pos + length(x) AS stop FROM (
      SELECT r, i, split_part(part, mark2, 1) AS x, i > 1 AS hit, coalesce(sum(length(replace(part, mark2, ''))) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos, mark2, crcs
      FROM (SELECT r, mark2, crcs, unnest(string_split(regexp_replace(text, '({pattern})', mark1 || '\\1' || mark2, 'g'), mark1)) AS part, generate_subscripts(string_split(regexp_replace(text, '({pattern})', mark1 || '\\1' || mark2, 'g'), mark1), 1) AS i FROM d))
    WHERE hit AND {fits}"""


_VALUE = "[A-Za-z0-9+/_.=-]+"
_NAME_SQL = """(?i:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?"""


def _crc_sql(prefix: int) -> str:
    """Whether a token of a prefix, 30 characters and six more ends in the CRC-32 of the 30 in base 62."""
    crc = f"xor(list_reduce(list_transform(range({prefix + 1}, {prefix + 31}), lambda k : ord(substr(x, k, 1))::BIGINT), lambda a, b : xor(a >> 8, crcs[(xor(a, b) & 255) + 1]), 4294967295), 4294967295)"
    digits = " || ".join(f"substr('{_DIGITS}', (({crc} // {62**k}) % 62 + 1)::BIGINT, 1)" for k in range(5, -1, -1))
    return f"length(x) = {prefix + 36} AND {digits} = substr(x, {prefix + 31})"


#: Patterns without keywords before them. Runs of letters and digits that are longer than a token hold none.
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, chr(57344) AS mark1, chr(57345) AS mark2,
  list_transform(range(256), lambda n : list_reduce(range(8), lambda c, k : CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS crcs FROM documents),
found AS (
  {_spans_sql("assign", _NAME_SQL + _VALUE, f"length(regexp_extract(x, '^{_NAME_SQL}({_VALUE})$', 1)) >= 12")}
  UNION ALL {_spans_sql("access", "AKIA[A-Z0-9]+", "length(x) >= 18")}
  UNION ALL {_spans_sql("hex", "[0-9a-f]+", "length(x) >= 16")}
  UNION ALL {_spans_sql("forge", "gh[pousr]_[A-Za-z0-9]+", _crc_sql(4))}
  UNION ALL {_spans_sql("package", "npm_[A-Za-z0-9]+", _crc_sql(4))}),
named AS (SELECT *, kind || ':' || pos || ':' || stop AS span, list_position({list(KINDS)}, kind) AS place FROM found),
told AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(span, ',' ORDER BY pos, place) FILTER (place <= 3) AS base, string_agg(span, ',' ORDER BY pos, place) AS spans FROM named GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told USING (r)
"""
