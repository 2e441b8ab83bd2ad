"""Term indexes, words one edit apart, keyed caches, mergeable profiles."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from cloakframe.operators import sketches, terms
from cloakframe.sources.keyed import KeyedCache


@pytest.mark.parametrize("most", [20_000, 0])
def test_postings_equal_expressions(spark, monkeypatch, most):
    monkeypatch.setattr(terms, "BROADCAST", most)
    rng = random.Random(1)
    words = ["go", "back", "Go", "don't", "well-known", "a", "b_c", "é", "x1"]
    docs = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", "  ", ", ", "\n", ""]) for _ in range(rng.randint(0, 30)))) for i in range(60)] + [(None, "go back"), (99, None), (98, "")]
    known = ["go", "go back", "don't", "well-known", "a", "b_c", "go  back", "back, go", "x1", "missing phrase"]
    lists = spark.createDataFrame([(t, len(t)) for t in known] + [("", 0), (" a", 1), (None, 2)], "term string, weight int")
    got = sorted((str(r.key), r.term, r.position) for r in terms.postings(spark.createDataFrame(docs, "id long, t string"), "id", "t", lists).collect())
    want = []
    for i, t in docs:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        segments = re.findall("[a-z0-9_]+|[^a-z0-9_]+", low)
        starts = {sum(map(len, segments[:k])): k for k in range(len(segments))}
        for term in known:
            for m in re.finditer(rf"(?=\b{re.escape(term)}\b)", low, re.A):
                want.append((str(i), term, starts[m.start()]))
    assert got == sorted(want)


def test_a_large_dictionary_costs_no_more(spark):
    lists = spark.range(100_000).select(F.concat(F.lit("phrase number "), F.col("id")).alias("term"), F.lit("c").alias("category"))
    docs = spark.createDataFrame([(1, "the phrase number 77 and phrase number 99999, phrase number 100000"), (2, "none")], "id long, t string")
    got = terms.counts(docs, "id", "t", lists, "category", ["c", "d"])
    assert {r.key: (r.c, r.d) for r in got.collect()} == {1: (2, 0), 2: (0, 0)}


def test_losses(spark):
    docs = spark.createDataFrame([(1, "go back, go", "go"), (2, "go", "go back go"), (None, "back", None)], "id long, a string, b string")
    lists = spark.createDataFrame([("go",), ("back",), ("go back",)], "term string")
    assert {(r.key, r.term, r.n_before, r.n_after) for r in terms.losses(docs, "id", "a", "b", lists).collect()} == {(1, "go", 2, 1), (1, "back", 1, 0), (1, "go back", 1, 0), (None, "back", 1, 0)}


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("longest", [64, 4])
def test_all_words_one_edit_apart(spark, monkeypatch, longest):
    monkeypatch.setattr(terms, "LONGEST", longest)
    rng = random.Random(2)
    make = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(0, 8)))
    left, right = [make() for _ in range(150)], [make() for _ in range(100)] + ["q" * 70]
    left += ["q" * 71, "q" * 35 + "z" + "q" * 34, None]
    got = {(r.left, r.right): r.distance for r in terms.within_one_edit(spark.createDataFrame([(x,) for x in left], "w string"), spark.createDataFrame([(x,) for x in right], "v string"), "w", "v").collect()}
    assert got == {(a, b): d for a in set(left) if a is not None for b in set(right) if (d := plain_distance(a, b)) <= 1}


def records(df):
    return {r.id: r.v for r in df.collect()}


def test_cache_upserts_and_reads_few_buckets(spark, tmp_path):
    cache = KeyedCache(spark, str(tmp_path / "c"), "id string, v string", "id", buckets=16)
    assert cache.read().count() == 0
    make = lambda rows: spark.createDataFrame(rows, "v string, id string")
    cache.append(make([(f"old{k}", f"k{k}") for k in range(100)]))
    cache.append(make([("new3", "k3"), ("x", None), ("aaa", "k4"), ("zzz", "k4")]))
    want = {f"k{k}": f"old{k}" for k in range(100)} | {"k3": "new3", "k4": "zzz"}
    assert records(cache.read()) == want
    few = cache.read(make([("", "k3"), ("", "k50"), ("", "none")]))
    assert records(few) == {"k3": "new3", "k50": "old50"}
    files = {f for f in few.inputFiles()}
    touched = {re.search("bucket=([0-9]+)", r.f)[1] for r in cache._rows(cache.parts()[1], [1, 2]).select(F.input_file_name().alias("f")).distinct().collect()}
    assert touched <= {"1", "2"} and files
    cache.compact()
    assert records(cache.read()) == want and len(cache.parts()[1]) == 1
    cache.append(make([("last", "k3")]))
    assert records(cache.read())["k3"] == "last"
    assert cache.clean() == 2 and records(cache.read()) == want | {"k3": "last"}


def test_crashes_lose_nothing(spark, tmp_path, monkeypatch):
    cache = KeyedCache(spark, str(tmp_path / "c"), "id string, v string", "id", buckets=4)
    make = lambda rows: spark.createDataFrame(rows, "id string, v string")
    cache.append(make([("a", "1")]))
    cache.append(make([("b", "2")]))

    def crash(change):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(cache, "_publish", crash)
        for act in (cache.compact, lambda: cache.append(make([("c", "3")]))):
            with pytest.raises(RuntimeError):
                act()
    assert records(cache.read()) == {"a": "1", "b": "2"} and len(os.listdir(tmp_path / "c" / "parts")) == 4

    # What comes while a compaction runs stays; a manifest whose number is taken is made again.
    publish = cache._publish

    def late(change):
        monkeypatch.setattr(cache, "_publish", publish)
        cache.append(make([("a", "9")]))
        publish(change)

    monkeypatch.setattr(cache, "_publish", late)
    cache.compact()
    assert records(cache.read()) == {"a": "9", "b": "2"} and len(cache.parts()[1]) == 2
    cache.clean()
    assert records(cache.read()) == {"a": "9", "b": "2"}


def test_profiles_merge(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, rng.choice([None, "", " ", f"name{rng.randrange(3000)}"]), str(rng.gauss(0, 100)) if k % 5 else "no number") for k in range(6000)]
    path, parts = str(tmp_path / "p"), [rows[:1000], rows[1000:2500], rows[2500:]]
    for k, part in enumerate(parts):
        sketches.append(spark.createDataFrame(part, "id long, name string, x string"), ["id", "name", "x"], str(k), path)
    stored = spark.read.parquet(path)
    got = {r.column_name: r for r in sketches.report(sketches.merged(stored)).collect()}
    twice = sketches.merged(stored.where("part < 2").drop("part").unionByName(sketches.merged(stored.where("part = 2"))))
    names = [v for _, v, _ in rows]
    assert got["name"].n_rows == 6000 and got["name"].n_null == names.count(None) and got["name"].n_blank == sum(v is not None and not v.strip() for v in names)
    for r in (got["name"], {r.column_name: r for r in sketches.report(twice).collect()}["name"]):
        assert abs(r.n_distinct - len(set(names) - {None})) <= 0.04 * len(set(names))
    numbers = sorted(float(x) for *_, x in rows if x != "no number")
    x = got["x"]
    assert (x.least, x.most) == (numbers[0], numbers[-1]) == (x.number_0, x.number_100)
    for p in (25, 50, 75, 90, 99):
        rank = sum(v <= x[f"number_{p}"] for v in numbers) / len(numbers)
        assert abs(rank - p / 100) < 0.03
    assert got["id"].length_100 == 4 and got["name"].number_50 is None
    # A new part reads only itself; making it again replaces it.
    sketches.append(spark.createDataFrame([(1, "only", "2")], "id long, name string, x string"), ["id", "name", "x"], "2", path)
    assert {r.n_rows for r in sketches.merged(spark.read.parquet(path)).collect()} == {2501}
