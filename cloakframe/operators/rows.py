"""Row identity, column roles, label predicates, excerpts, searches."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.operators.scans import overlap_semi  # noqa: F401  it has stood here

SENSITIVE = frozenset(("user", "author", "email", "mail", "phone", "name", "handle", "username", "ip"))


def is_sensitive(column: str) -> bool:
    """Whether a part of the column's name, split at _ and -, tells of a person."""
    return any(p in SENSITIVE for p in re.split(r"[_-]", column.lower()))


def report_row_id(id_column: str | None, index: Column) -> Column:
    """The trimmed id, unless the column is sensitive or the id blank; else the 1-based row index."""
    if id_column is None or is_sensitive(id_column):
        return index.cast("string")
    value = F.trim(F.col(id_column).cast("string"))
    return F.when(value != "", value).otherwise(index.cast("string"))


def insert_after(columns: list[str], anchor: str, added: list[str]) -> list[str]:
    """Column order with the added ones right after the anchor (at the end if there is none)."""
    rest = [c for c in columns if c not in added]
    at = rest.index(anchor) + 1 if anchor in rest else len(rest)
    return [*rest[:at], *added, *rest[at:]]


def first_nonempty(*values: Column) -> Column:
    return F.coalesce(*(F.when(F.trim(v.cast("string")) != "", F.trim(v.cast("string"))) for v in values))


def parse_float(value: Column) -> Column:
    """The number, or null."""
    return F.trim(value).try_cast("double")


def split_pipe(value: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def excerpt(text: Column, words: int = 32) -> Column:
    return F.array_join(F.slice(F.split(F.trim(text), "[ \\t\\n\\r\\f]+"), 1, words), " ")


def public_case_id(*parts: Column) -> Column:
    """case- and the FNV-1a hash (32 bits, of code points up to U+FFFF) of the parts, in hex."""
    codes = F.transform(F.filter(F.split(F.concat_ws("\x1f", *parts), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    h = F.aggregate(codes, F.lit(2166136261).cast("bigint"), lambda h, c: (h.bitwiseXOR(c) * 16777619) % 4294967296)
    return F.concat(F.lit("case-"), F.lpad(F.lower(F.hex(h)), 8, "0"))


def matches_search(query: str, *values: Column) -> Column:
    """Whether any value holds the query, not counting case; an empty query matches all."""
    q = query.strip().lower()
    out = F.lit(not q)
    for v in values:
        out = out | F.contains(F.lower(F.coalesce(v.cast("string"), F.lit(""))), F.lit(q))
    return out


def matches_filter(kind: str, risk: Column, label: Column) -> Column:
    if kind == "all":
        return F.lit(True)
    return risk.isin("high", "medium") if kind == "flagged" else label == kind


def window(df: DataFrame, index: str, offset: int, limit: int) -> DataFrame:
    """Rows offset + 1 to offset + limit by their 1-based index; no sort, and the bounds reach the scan."""
    return df.where(F.col(index).between(offset + 1, offset + limit))
