"""Parallel CSV against one reader over the whole file."""

import csv
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from cloakframe.sources import exact_csv as X

SAMPLE = 'id,text,"a b"\r\n1,"two\nlines, and ""quotes""",x\r\n\r\n2,bare "quote" here,\n3,"q"tail"more,y\r4,é日🙂,"\r\n"\r\n5,,\n"6","",""""\n'.encode()


def plain(data: bytes):
    rows = [r for r in csv.reader(io.StringIO(data.decode("utf-8-sig"), newline="")) if r]
    return rows[0], rows[1:]


def by_ranges(path, data, cuts, block):
    """What tasks over these cuts read, with states composed from the first pass."""
    edges = [0, *cuts, len(data)]
    state, rows, out = X.BETWEEN, 0, []
    for low, high in zip(edges, edges[1:]):
        out += list(X.records(path, X.Range(low, high, state, rows), len(data), block))
        to, begun = X.effect(X.blocks(path, low, high, block))
        state, rows = to[state], rows + begun[state]
    return out


@pytest.mark.parametrize("block", [1, 3, 7, 1 << 20])
def test_every_cut_of_a_sample(tmp_path, block):
    path = str(tmp_path / "a.csv")
    open(path, "wb").write(SAMPLE)
    names, rows = plain(SAMPLE)
    want = list(enumerate([names, *rows]))
    for cut in range(len(SAMPLE) + 1):
        assert by_ranges(path, SAMPLE, [cut], block) == want, cut
    for low in range(0, len(SAMPLE), 5):
        assert by_ranges(path, SAMPLE, [low, min(low + 2, len(SAMPLE)), len(SAMPLE)], block) == want


def test_states_are_those_of_one_reader():
    rng = random.Random(1)
    for _ in range(3000):
        data = "".join(rng.choice(['"', '""', ",", "\r", "\n", "\r\n", "a", "é", " "]) for _ in range(rng.randint(0, 25)))
        want = [r for r in csv.reader(io.StringIO(data, newline="")) if r]
        starts = []
        _, n = X.walk(data.encode(), X.BETWEEN, starts)
        assert n == len(starts) == len(want), data


def test_read_equals_one_reader(spark, tmp_path):
    rng = random.Random(2)
    text = io.StringIO(newline="")
    w = csv.writer(text)
    w.writerow(["row_index", "text", "b,c"])
    cells = ["", "x", "a,b", 'say "so"', "two\r\nlines", "é日🙂" * 30, '"', "\n\n", "long " * 400]
    for i in range(700):
        w.writerow([i, rng.choice(cells), rng.choice(cells)])
    data = b"\xef\xbb\xbf" + text.getvalue().encode()
    path = str(tmp_path / "b.csv")
    open(path, "wb").write(data)
    names, rows = plain(data)
    df = X.read(spark, path, range_bytes=5000)
    assert df.columns == ["row_index", *names]
    got = sorted(map(tuple, df.collect()))
    assert df.rdd.getNumPartitions() == -(-(len(data) - 3) // 5000)
    assert got == [(i, *r) for i, r in enumerate(rows, 1)]


def test_rows_of_other_lengths(spark, tmp_path):
    path = str(tmp_path / "c.csv")
    open(path, "wb").write(b"a,b\n1\n1,2\n")
    assert sorted(map(tuple, X.read(spark, path).collect())) == [(1, "1", ""), (2, "1", "2")]
    open(path, "wb").write(b"a,b\n1,2,3\n")
    with pytest.raises(Exception, match="row 1 has 3 cells"):
        X.read(spark, path).collect()
    open(path, "wb").write(b"a,b\n1,\xff\n")
    with pytest.raises(Exception, match="invalid UTF-8 at byte 6"):
        X.read(spark, path).collect()
    open(path, "wb").write(b"\n")
    with pytest.raises(ValueError, match="header"):
        X.read(spark, path)


def test_write_equals_one_writer(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.choice(["", None, "x", "a,b", 'q"q', "l\r\nl", "é"]), i / 4) for i in range(500)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "row_index long, t string, v double").repartition(7)
    path = str(tmp_path / "deep" / "d.csv")
    X.write(df, path, ["t", "missing", "v", "t"])
    text = io.StringIO(newline="")
    w = csv.writer(text)
    w.writerow(["t", "missing", "v", "t"])
    w.writerows([t or "", "", v, t or ""] for _, t, v in rows)
    assert open(path, "rb").read() == text.getvalue().encode()
    assert os.listdir(tmp_path / "deep") == ["d.csv"]
    X.write(df.limit(0), path, ["t"])  # an old file is replaced at once
    assert open(path, "rb").read() == b"t\r\n"


def test_failed_tasks_leave_nothing(spark, tmp_path):
    path = str(tmp_path / "e.csv")
    df = spark.range(100).select(F.col("id").alias("row_index"), F.when(F.col("id") < 60, F.lit("x")).otherwise(F.raise_error(F.lit("lost"))).alias("t"))
    with pytest.raises(Exception, match="lost"):
        X.write(df, path, ["t"])
    assert os.listdir(tmp_path) == []


def test_retried_tasks_count_once(spark, tmp_path):
    """Parts of an attempt that failed lie beside, and are not taken."""
    writer = X._Writer({"path": str(tmp_path / "f.csv"), "staging": str(tmp_path / "p"), "columns": '["t"]'}, None)
    os.makedirs(tmp_path / "p")
    for name, body in (("0-a", b"old\r\n"), ("0-b", b"new\r\n"), ("1-c", b"two\r\n")):
        open(tmp_path / "p" / name, "wb").write(body)
    writer.commit([X.Part(1, str(tmp_path / "p" / "1-c"), 1), X.Part(0, str(tmp_path / "p" / "0-b"), 1)])
    assert open(tmp_path / "f.csv", "rb").read() == b"t\r\nnew\r\ntwo\r\n" and os.listdir(tmp_path) == ["f.csv"]
