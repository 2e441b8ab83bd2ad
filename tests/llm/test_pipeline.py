"""The pipeline against a plain version of each stage, and the registration of its queries."""

import random
import re
import zlib
from collections import Counter

import numpy as np

import __spark_entry__
import corpus_pipeline
from cloakframe.llm import decontam, kit, mixing, quality, queries
from tests.llm.test_operators import linked, prose, words


def test_stages_have_their_effect(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    frames = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = kit.stored(stage(spark, frames[-1], sf), str(tmp_path / str(k)))
        if k < 4:
            assert out.columns == docs.columns
        frames.append(out)
    rows = [[tuple(r) for r in f.collect()] for f in frames]
    # 1: what the rules keep, row by row
    judged = {r.doc_id: r.kept for r in quality.judge(docs).select("doc_id", "kept").collect()}
    assert Counter(rows[1]) == Counter(r for r in rows[0] if judged[r[0]])
    # 2: the least id of each group of linked documents
    links, top = linked(rows[1]), list(range(len(rows[1])))
    changed = True
    while changed:
        new = [min([top[i], *(top[j] for j in x)]) for i, x in enumerate(links)]
        changed, top = new != top, new
    least = {}
    for i, g in enumerate(top):
        least[g] = min(least.get(g, rows[1][i]), rows[1][i])
    assert Counter(rows[2]) == Counter(least.values())
    # 3: every item lies whole in no document that stays
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    plain = lambda t: " ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in t)))
    kept = [f" {plain(r[1])} " for r in rows[3]]
    assert not any(f" {plain(b)} " in t for b in bench for t in kept)
    assert set(rows[3]) <= set(rows[2])
    dirty = {r[0] for r in rows[2]} - {r[0] for r in rows[3]}
    assert dirty == {r.doc_id for r in decontam.find(frames[2], spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    # 4: words of each source near its target, no row more than twice
    goal = {r.source: r.target for r in mixing.plan(frames[3]).select("source", "target").distinct().collect()}
    taken = Counter()
    for r in rows[4]:
        taken[r[3]] += len(words(r[1]))
    longest = max(len(words(r[1])) for r in rows[3])
    assert all(abs(taken[s] - goal[s]) <= longest for s in goal) and set(Counter(rows[4]).values()) <= {1, 2} and set(rows[4]) <= set(rows[3])
    # 5: ids of every row of the mix, in order
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    texts = {r[0]: r[1] for r in rows[4]}
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, queries.END_ID], "<u4") for i, t in texts.items()}
    assert Counter((r[0], r[2], r[3]) for r in rows[5]) == Counter((r[0], len(ids[r[0]]), zlib.crc32(ids[r[0]].tobytes())) for r in rows[4])
    ends = sorted((r[1], r[1] + r[2]) for r in rows[5])
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))


def test_stages_take_odd_tables(spark, sf, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, score double, times int, __row string"
    text, long = prose(random.Random(3), 300), prose(random.Random(4), 20_000)
    odd = [(1, text, "en", None, 1, 1, None, None, 1, None), (1, text, "en", None, 1, 1, None, None, 1, None), (2, text + " more", None, "s", None, 2, True, 0.1, 2, "x"), (None, None, None, None, None, None, None, None, None, None), (3, "", "", "", 0, 0, False, 0.0, 0, ""), (4, long, "en", "s", 1, 1, None, None, None, None)]
    for name, rows in (("odd", odd), ("none", [])):
        docs = spark.createDataFrame(rows, schema)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            columns = docs.columns
            docs = kit.stored(stage(spark, docs, sf), str(tmp_path / f"{name}{k}"))
            assert k == 4 or docs.columns == columns
        left = sorted(r.doc_id for r in docs.collect())
        assert set(left) == ({1, 4} if rows else set()) and all(left.count(i) <= 2 for i in left)


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_companions_against_sql(spark, sf):
    """The columns that SQL can say."""
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    for name in ("quality_rule_counts", "mixing_targets"):
        got = queries.QUERIES[name](spark, sf)
        expected = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE[name]})").fetchall()
        assert Counter(map(tuple, got.collect())) == Counter(expected)
