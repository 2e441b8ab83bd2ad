"""URL filters: sort-merge range join of urls with host-and-path rules.

A host is turned round (com, example, www), each label closed by \\x01, so that a
rule for a host and its subdomains is the interval of keys that begin with the
rule's.  Urls and rules are dealt to ranges of keys; a rule goes to every range
that its interval meets.  In each range the sorted rows are swept once, with a
stack of the nested host rules that are open, and the longest rule whose path
fits wins (for equal length, the one with the longer host).

Neither urls nor rules are broadcast.  Ranges are cut at keys taken from a
hash sample of the urls that also holds path and id, so a host or url that
holds a third of all rows is spread over many ranges.  The sample sets only
the cuts; every row is judged.

Defined cases: a url that is null or has no :// has an empty host and path and
fits no rule; repeated rows are judged alike; an empty rule table or an empty
url table gives the default verdict or no row.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakframe.llm import kit

_UPPER = {c: c + 32 for c in range(65, 91)}
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)


def split(url: str | None) -> tuple[str, str]:
    """(host, path) of a url."""
    m = _URL.search(url or "")
    return (m[1].translate(_UPPER), m[2]) if m else ("", "")


def turned(host: str) -> str:
    return "".join(f"{x}\x01" for x in reversed(host.split("."))) if host else ""


def sweep(rows, default: str):
    """rows: (key, kind, path, payload) in order; kind 0 is a rule (payload: rule, verdict), 1 a url. Yields (payload, rule, verdict)."""
    stack: list[tuple[str, dict]] = []
    for key, kind, path, payload in rows:
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        if kind == 0:
            if not stack or stack[-1][0] != key:
                stack.append((key, {}))
            stack[-1][1][path] = payload
            continue
        best = None
        for depth, (_, rules) in enumerate(stack):
            for prefix, (rule, verdict) in _fitting(rules, path):
                found = (len(rule), depth, rule, verdict)
                best = found if best is None or found[:2] > best[:2] else best
        yield payload, best and best[2], best[3] if best else default


def _fitting(rules: dict, path: str):
    """The longest of one host's path rules that begins the path."""
    lengths = rules.get(None)
    if lengths is None or lengths[0] != len(rules):
        lengths = rules[None] = (len(rules) + (None not in rules), sorted({len(p) for p in rules if p is not None}, reverse=True))
    for n in lengths[1]:
        if n <= len(path) and (got := rules.get(path[:n])):
            return [(path[:n], got)]
    return []


def native(url: F.Column) -> tuple[F.Column, F.Column, F.Column]:
    """(host, path, turned host) of a url."""
    host, path = (F.coalesce(F.regexp_extract(url, _URL.pattern, k), F.lit("")) for k in (1, 2))
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = F.when(host != "", F.concat(F.concat_ws("\x01", F.reverse(F.split(host, "\\."))), F.lit("\x01"))).otherwise("")
    return host, path, key


def _range(cuts: list[str], place: F.Column) -> F.Column:
    """How many of the sorted cuts are not above the place; a binary search."""
    if not cuts:
        return F.lit(0)
    every = F.array(*map(F.lit, cuts))

    def halve(acc, _):
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        below = F.element_at(every, mid + 1) <= place
        go = acc["lo"] < acc["hi"]
        return F.struct(F.when(go & below, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(go & ~below, mid).otherwise(acc["hi"]).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length())), start, halve, lambda acc: acc["lo"])


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", key: str = "page_id", ranges: int | None = None) -> DataFrame:
    """key, host, path, rule, verdict of every row. rules: host, path, verdict (a host without dots at its ends, lower case).

    All but the sweep is native.
    """
    spark = pages.sparkSession
    kind = pages.schema[key].dataType
    host, path, turned_host = native(F.col("__url"))
    source = pages.select(pages[f"`{key}`"].alias("__id"), pages[f"`{url}`"].cast("string").alias("__url"))
    urls = source.select("__id", turned_host.alias("k"), host.alias("host"), path.alias("path"))
    place = F.concat("k", F.lit("\x00"), "path", F.lit("\x00"), F.hex(F.xxhash64("__id")))
    # About 64 keys for each cut, whatever the number of rows; equal rows come once, with their number. They bound the ranges only.
    rows, size = source.agg(F.count("*"), F.sum(F.octet_length("__url"))).first()
    ranges = ranges or max(1, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), (size or 0) >> 25)
    every = max(1, rows // (64 * ranges))
    some = urls.select(place.alias("x"), F.xxhash64("__id", "k", "path").alias("h")).where(F.pmod("h", F.lit(every)) == 0).groupBy("x").agg(F.count("*").alias("n"))
    sample = sorted((x.encode() for x, n in some.collect() for _ in range(max(1, min(n, 64 * ranges * n // max(1, rows))))))
    cuts = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []

    def spread(batches):
        """Every rule, once for each range that its interval meets."""
        for batch in batches:
            out = []
            for host, path, verdict in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "verdict"))):
                k = turned((host or "").translate(_UPPER))
                low, high = k.encode(), k.encode()[:-1] + b"\x02" if k else None
                last = len(cuts) if high is None else bisect_right(cuts, high)
                out += [(r, k, path or "", f"{host or ''}{path or ''}", verdict) for r in range(bisect_right(cuts, low), last + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()))], names=["range", "k", "path", "rule", "verdict"])

    null = lambda t: F.lit(None).cast(t)
    ruled = rules.select(*(rules[f"`{c}`"].cast("string").alias(c) for c in ("host", "path", "verdict"))).dropDuplicates(["host", "path"])
    ruled = ruled.mapInArrow(kit.trimmed(spread), "range int, k string, path string, rule string, verdict string").select("range", "k", F.lit(0).alias("kind"), "path", null(kind).alias("__id"), null("string").alias("host"), "rule", "verdict")
    events = urls.select(_range([c.decode() for c in cuts], place).cast("int").alias("range"), "k", F.lit(1).alias("kind"), "path", "__id", "host", null("string").alias("rule"), null("string").alias("verdict")).unionByName(ruled)
    # Order within a range: by key, rules before urls; a rule of a range comes before all keys it covers.
    events = events.repartition(ranges, "range").sortWithinPartitions("range", "k", "kind", "path")

    def swept(batches):
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("range", "k", "kind", "path", "__id", "host", "rule", "verdict")))

        out = []

        def block():
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((id_type, *[pa.string()] * 4))], names=[key, "host", "path", "rule", "verdict"])

        feed = ((f"{r}\x02{k}", kind, path, (rule, verdict) if kind == 0 else (i, host, path)) for r, k, kind, path, i, host, rule, verdict in rows())
        for (i, host, path), rule, verdict in sweep(feed, default):
            out.append((i, host, path, rule, verdict))
            if len(out) >= 10000:
                yield block()
                out.clear()
        if out:
            yield block()

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(kind)
    return events.mapInArrow(kit.trimmed(swept), T.StructType([T.StructField(key, kind), *(T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict"))]))
