"""Two-pass scans and cells against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from cloakframe.operators import scans


def plain_merge(rows):
    out = []
    for g, a, b in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        if out and out[-1][0] == g and a <= out[-1][2]:
            out[-1][2], out[-1][3] = max(out[-1][2], b), out[-1][3] + 1
        else:
            out.append([g, a, b, 1])
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("seed, spread", [(1, 50), (2, 4000), (3, 400)])
def test_merge_with_a_hot_group(spark, seed, spread):
    rng = random.Random(seed)
    rows = [(0 if rng.random() < 0.5 else rng.choice([1, 2, 3, None]), a := rng.randint(0, spread), a + rng.randint(1, 12)) for _ in range(600)]
    rows += [(7, 5, 100_000), *((7, k, k + 1) for k in range(10, 500, 7)), (8, 3, 4), (8, 3, 9), (8, 3, 4)]
    df = spark.createDataFrame(rows, "g int, a int, b int").repartition(5)
    got = sorted((tuple(r) for r in scans.merged(df, ["g"], "a", "b").collect()), key=str)
    assert got == plain_merge(rows)


def test_a_hot_group_lies_in_several_ranges(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("g"), F.col("id").alias("a"))
    rows = scans.ranged(df, ["g", "a"])
    hot = [r.n for r in rows.where("g = 0").groupBy(scans.RANGE).agg(F.count("*").alias("n")).collect()]
    assert len(hot) >= 2 and max(hot) <= 4000 / int(spark.conf.get("spark.sql.shuffle.partitions")) * 1.7


def test_runs(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(300)])) for _ in range(500)]
    got = sorted((tuple(r) for r in scans.runs(spark.createDataFrame(rows, "g string, v long"), ["g"], "v").collect()), key=str)
    want = []
    for g in ("a", "b", None):
        for v in sorted({v for h, v in rows if h == g and v is not None}):
            if want and want[-1][0] == g and want[-1][2] == v - 1:
                want[-1][2], want[-1][3] = v, want[-1][3] + 1
            else:
                want.append([g, v, v, 1])
    assert got == sorted(map(tuple, want), key=str)
    assert scans.runs(spark.createDataFrame([], "g string, v long"), ["g"], "v").count() == 0


def test_running_sums_compute_their_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def see(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame([(float(k), k) for k in range(100)], "x double, n long").repartition(3).mapInArrow(see, "x double, n long")
    got = sorted(scans.running_sums(df, "x", ["n"]).collect())
    assert [r.upto_n for r in got] == [k * (k + 1) // 2 for k in range(100)] and {r.all_n for r in got} == {4950}
    assert seen.value <= 200  # once for the bounds of ranges, once for the rows


def plain_overlap(left, right):
    return sorted((x for x in left if any(x[0] == y[0] and x[1] < y[2] and y[1] < x[2] for y in right)), key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_overlap_of_all_lengths(spark, seed):
    rng = random.Random(seed)

    def some(n):
        return [(rng.choice([1, 2, None]), a := rng.randint(-500, 500) * 10 ** rng.randint(0, 3), a + rng.choice([-3, 0, 1, 2, 64, 100, 4096, 10**5])) for _ in range(n)]

    left, right = some(200), [r for r in some(30)]
    left += left[:5]
    frames = [spark.createDataFrame(x, "g int, a long, b long") for x in (left, right)]
    nulls = lambda rows: [tuple("-" if v is None else v for v in r) for r in rows]
    got = sorted(map(tuple, scans.overlap_semi(*frames, ["g"], "a", "b").collect()), key=str)
    assert nulls(got) == sorted(nulls(plain_overlap(left, right)), key=str) or got == plain_overlap(left, right)


def test_long_intervals_have_few_cells(spark):
    long = spark.createDataFrame([(1, 7, 7 + 10**9), (1, -5, 2)], "g int, a long, b long")
    short = spark.createDataFrame([(1, 10**8, 10**8 + 1), (1, 2 * 10**9, 2 * 10**9 + 5)], "g int, a long, b long")
    levels = list(range(40))
    assert scans.cells(long, "a", "b").where("a = 7").count() <= 2
    assert scans.cells(short, "a", "b", levels=levels).groupBy("a").count().agg(F.max("count")).first()[0] < 64 + 16
    assert [tuple(r) for r in scans.overlap_semi(long, short, ["g"], "a", "b").collect()] == [(1, 7, 7 + 10**9)]
    assert [tuple(r) for r in scans.overlap_semi(short, long, ["g"], "a", "b").collect()] == [(1, 10**8, 10**8 + 1)]
