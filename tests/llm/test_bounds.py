"""Inputs that could fill a task or stop a job, ids of other types, and plain versions of results that SQL cannot say."""

import itertools
import random
import re
import time
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from cloakframe.llm import chaining, components, decontam, html, jaccard, kit, lm, mixing, quality, queries, suffix, tokens
from tests.llm.test_operators import brute_suffix, linked, prose, words

HOSTILE = {
    "open tags": "<a" * 100_000,
    "open quote": "<p title='x>" * 50_001,
    "quote without end": '<a x="' * 50_001,
    "full spans": "<table>" + "<tr><td colspan=1000 rowspan=1000>x" * 1000,
    "tables in tables": "<table><tr><td>a<td>" * 50 + "x",
    "tables in many tables": "<table><tr><td>a<td>" * 5000 + "x",
    "fenced paragraphs": "<p><table><tr><td>" + "<div>" * 100_000 + "x",
    "rows without a table": "<div>" * 50_000 + "<tr>y" * 50_000,
    "lists in lists": "<ul><li>x" * 20_000,
    "long reference": "&#" + "9" * 100_000 + ";x",
    "wide column": "<table><tr><td>" + "w " * 100_000 + "<td>z" + "<tr><td><td>x" * 20_000,
    "comments": "<!--" * 50_000,
    "moved out": "<table><tr>" + "<div>x" * 50_000,
    "wrong ends": "<b>" * 50_000 + "</i>" * 50_000,
    "many attributes": "<p " + "hidden " * 100_000 + "x=y>z",
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages(name):
    start = time.process_time()
    html.render(HOSTILE[name])
    assert time.process_time() - start < 4


def test_nothing_is_lost_at_depth():
    for deep in (20, 200, 2000):
        page = "".join(f"<table><tr><td>a{i}<td>" for i in range(deep)) + "end"
        assert set(html.render(page).split()) == {*(f"a{i}" for i in range(deep)), "end"}
    assert html.render("<a x='never closed") == "<a x='never closed"
    wide = html.render("<table><tr><td>" + "w " * 3000 + "<td>z<tr><td>a<td>b</table>")
    assert wide.split("\n")[1] == "a  b"


def test_layout_against_a_plain_renderer():
    """Random documents of paragraphs, lists in lists and tables, each with the text that its layout asks for."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))

    def phrase():
        return " ".join(word() for _ in range(rng.randint(1, 6)))

    def paragraph():
        x = phrase()
        return f"<p>{x.replace(' ', rng.choice([' ', '  ', chr(10), ' <b> </b>']), 1)}" + rng.choice(["</p>", ""]), [x]

    def listing(depth=0):
        kind, start = rng.choice(["ul", "ol"]), rng.randint(1, 12)
        page, lines = f"<{kind} start={start}>", []
        for k in range(rng.randint(1, 4)):
            mark, x = "- " if kind == "ul" else f"{start + k}. ", phrase()
            page += f"<li>{x}"
            lines.append(mark + x)
            if depth < 2 and rng.random() < 0.3:
                inner, more = listing(depth + 1)
                page += inner
                lines += [" " * len(mark) + m for m in more]
            page += rng.choice(["</li>", ""])
        return page + f"</{kind}>", lines

    def table():
        rows, columns = rng.randint(1, 5), rng.randint(1, 4)
        cells = [[phrase() if rng.random() < 0.9 else "" for _ in range(columns)] for _ in range(rows)]
        page = "<table>" + "".join("<tr>" + "".join(f"<td>{c}" + rng.choice(["</td>", ""]) for c in r) for r in cells) + "</table>"
        width = [max(len(r[k]) for r in cells) for k in range(columns)]
        kept = [k for k in range(columns) if width[k]]
        return page, [line for r in cells for line in ["  ".join(r[k].ljust(width[k]) for k in kept).rstrip()] if line]

    for _ in range(150):
        parts = [rng.choice([paragraph, listing, table])() for _ in range(rng.randint(1, 7))]
        parts = [p for p in parts if p[1]]
        assert html.render("".join(p for p, _ in parts)) == "\n\n".join("\n".join(lines) for _, lines in parts)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(21)
    base = [prose(rng, 60) for _ in range(8)]
    return base + [base[0], base[1] + " more", None, "", base[2] + " " + base[3]]


def test_ids_of_other_types(spark, texts, tmp_path):
    """Text ids are kept as they are, and give what long ids give."""
    schema = "{} {}, text string, source string, __text string, __block int, sig binary, many int"
    rows = lambda name: [(name(i), t, "s", "x", 1, None, 2) for i, t in enumerate(texts)]
    name = lambda i: f"d{i:03}"
    named, plain = spark.createDataFrame(rows(name), schema.format("doc_id", "string")), spark.createDataFrame(rows(int), schema.format("doc_id", "long"))
    back = lambda v: int(v[1:]) if isinstance(v, str) and re.fullmatch(r"d\d{3}", v) else v
    bench = spark.createDataFrame([("i1", texts[4])], "item_id string, text string")
    path = queries.tokenizer_path()
    for k, f in enumerate((suffix.dedup, jaccard.join, chaining.passages, lambda d: decontam.find(d, bench), lambda d: tokens.read(tokens.write(d, path, 2, kit.scratch(spark))))):
        a, b = (Counter(tuple(map(back, r)) for r in f(d).collect()) for d in (named, plain))
        assert a == b and a, k
    assert {type(r.doc_id) for r in lm.score(named).collect()} == {str}
    for f in (jaccard.dedup, lambda d: decontam.clean(d, bench), quality.keep, mixing.mix):
        assert f(named).schema == named.schema


def test_rows_that_repeat_are_dealt_out(spark, texts, monkeypatch):
    monkeypatch.setattr(kit, "COPIES", 5)
    monkeypatch.setattr(kit, "BLOCK_BYTES", 400)
    made = [(1, texts[0])] * 43 + [(None, texts[1])] * 12 + [(i, t) for i, t in enumerate(texts)] + [(9, None)] * 11
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(5)
    dealt = kit.Dealt(docs, "text", "doc_id")
    rows = dealt.rows.collect()
    assert Counter((r.doc_id, r["__text"]) for r in rows) == Counter((i, t or "") for i, t in made)
    assert Counter((r.doc_id, r["__text"]) for r in dealt.rows.collect()) == Counter((r.doc_id, r["__text"]) for r in rows)
    alone = Counter(r["__block"] for r in rows if r["__text"] == texts[0] and r.doc_id == 1)
    assert len(alone) > 3 and max(alone.values()) <= 15
    assert Counter(tuple(r) for r in suffix.dedup(docs).collect()) == brute_suffix(made, 200)
    found = Counter(r.doc_id for r in chaining.passages(docs).collect())
    assert found[1] == 44
    assert len(lm.score(docs).collect()) == len(made)


def test_buckets_grow_with_the_root_of_the_blocks(spark):
    """The bytes that a block sends hardly grow when there are many more blocks."""
    rng, gen = random.Random(5), np.random.default_rng(5)
    vocabulary = [prose(rng, 1) + str(i) for i in range(30_000)]
    text = " ".join(vocabulary[int(k) % 30_000] for k in gen.zipf(1.2, 400_000))
    docs = pa.table({"doc_id": [1], "__text": [text], "__block": pa.array([0]), "__held": [False]})
    buckets = {blocks: kit.buckets_of(blocks) for blocks in (170, 10_000)}
    for f in (lambda n: suffix._ask(docs, None, 200, n, np.zeros(0, np.uint64)), lambda n: chaining._tell(docs, n), lambda n: lm._ask(docs, lm.NONE, n)):
        size = {b: f(n) for b, n in buckets.items()}
        size = {b: sum(len(x.as_py()) for c in t.column_names if pa.types.is_binary(t.schema.field(c).type) for x in t[c] if x.is_valid) + 60 * t.num_rows for b, t in size.items()}
        assert size[10_000] < 1.2 * size[170], size


def test_a_hot_hash_over_several_blocks(spark, monkeypatch):
    """One long line in front of many different ones: its strings are the least of very many stretches, in every block."""
    monkeypatch.setattr(suffix, "HOT", 20)
    monkeypatch.setattr(suffix, "LOCAL", 8)
    monkeypatch.setattr(kit, "BLOCK_BYTES", 4000)
    rng = random.Random(2)
    head = prose(rng, 30)[:150]
    made = [(i, head + "".join(rng.choice("ab") for _ in range(rng.randint(40, 90))) + head[:120]) for i in range(150)]
    got = Counter(tuple(r) for r in suffix.dedup(spark.createDataFrame(made, "doc_id long, text string")).collect())
    assert got == brute_suffix(made, 200)


def test_passages_beyond_the_reach(spark):
    """A passage that goes on long after its last anchor with the partner, since its later words have other holders."""
    rng = random.Random(13)
    passage = prose(rng, 200).split()
    quotes = [" ".join(passage[a : a + 11]) + " " + prose(rng, 30) for a in range(0, 190, 7)]
    made = [(0, prose(rng, 30) + " " + " ".join(passage)), (1, " ".join(passage) + " " + prose(rng, 30))] + [(2 + k, q) for k, q in enumerate(quotes)]
    order = [*range(len(made))]
    rng.shuffle(order)
    got = {r.doc_id: (r.word_from, r.word_to) for r in chaining.passages(spark.createDataFrame([made[k] for k in order], "doc_id long, text string")).collect()}
    assert got[0] == (30, 230) and got[1] == (0, 200)
    own, other = np.arange(500), np.arange(500)
    assert chaining.align(own, other, 0, [(10, 10, 20)], 10, 400) == (0, 430, 0, 430, 430)
    assert chaining.align(own, other, 0, [(10, 10, 20)]) == (0, 62, 0, 62, 62)


def test_passages_on_odd_tables(spark):
    rng = random.Random(14)
    shared, long = prose(rng, 60), prose(rng, 30_000)
    rows = [(1, shared + " " + prose(rng, 20), "a", 1, 2), (1, shared, "b", 1, 2), (1, shared, "b", 1, 2), (2, long + " " + shared, None, 1, 2), (3, None, None, None, None), (None, shared, None, None, None), (4, "w " * 5000, None, None, None), (5, "w " * 4000, None, None, None)]
    got = Counter(r.doc_id for r in chaining.passages(spark.createDataFrame(rows, "doc_id long, text string, first string, n_equal int, other_id int")).collect())
    assert got == Counter({1: 3, 2: 1, None: 1})


def test_knapsack_in_little_memory():
    lengths = 2 * np.arange(1, 2001)
    tracemalloc.start()
    for goal in (399_999, 400_001, 7):
        got = mixing.subset(lengths, np.full(2000, 3), goal)
        assert int((got * lengths).sum()) == goal - 1 and (got <= 3).all()
    got = mixing.subset(np.array([5, 7, 3_000_000]), np.array([1000, 1000, 1]), 3_004_001)
    assert int((got * np.array([5, 7, 3_000_000])).sum()) == 3_004_001
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()
    assert mixing.subset(np.array([3]), np.array([9]), 5).tolist() == [2] and mixing.subset(np.array([3]), np.array([9]), 4).tolist() == [1]


def test_mixing_with_a_very_long_document(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(1, 30)), "ab"[i % 2]) for i in range(200)] + [(900, "w " * 50_000, "a")]
    got = mixing.plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in "ab":
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 50_000


def plain_matches(doc, item, least):
    """Best stretch on the diagonals that a seed lies on, by trying them all."""
    w = [x.lower() for x in re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", doc)]
    b = [x.lower() for x in re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", item)]
    best = 0
    masks = decontam.MASKS if len(b) >= 5 else ["1" * len(b)] if b else []
    for shift in range(-len(b) + 1, len(w)):
        if not any(all(0 <= shift + a + j < len(w) and w[shift + a + j] == b[a + j] for j, c in enumerate(m) if c == "1") and shift + a >= 0 and shift + a + len(m) <= len(w) for m in masks for a in range(len(b) - len(m) + 1)):
            continue
        row = [(w[shift + k] == b[k]) for k in range(len(b)) if 0 <= shift + k < len(w)]
        top, score, equal = (0, 0), 0, 0
        for hit in row:
            score, equal = (score + 1, equal + 1) if hit else (score - decontam.MISS, equal)
            if score <= 0:
                score = equal = 0
            if score > top[0]:
                top = (score, equal)
        best = max(best, top[1])
    return best if b and best >= min(least, len(b)) else 0


def test_decontamination_against_brute_force():
    rng = random.Random(6)
    for vocabulary in (2, 3, 8, 200):
        say = lambda n: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz"[: min(26, vocabulary)]) + (str(rng.randrange(vocabulary)) if vocabulary > 26 else "") for _ in range(n))  # noqa: B023, E731
        items = [say(rng.randint(1, 30)) for _ in range(12)]
        docs = [say(rng.randint(0, 60)) for _ in range(15)] + [say(9) + " " + items[k] + " " + say(5) for k in range(6)]
        ix = decontam.index([*range(12)], items)
        got = decontam.matches(pa.array(docs), ix)
        found = {(a, b): n for a, b, n in zip(got["text"].tolist(), got["item"].tolist(), got["n_match"].tolist())}
        for (a, doc), (b, item) in itertools.product(enumerate(docs), enumerate(items)):
            expected = plain_matches(doc, item, decontam.LEAST)
            assert ((a, b) in found) == (expected > 0), (doc, item, found.get((a, b)), expected)


def test_decontamination_of_repeated_and_long_words(spark):
    start = time.process_time()
    ix = decontam.index([0, 1], ["w " * 1000, "a b c " * 50])
    got = decontam.matches(pa.array(["w " * 200_000, "a b c " * 20_000, "c a b"]), ix)
    assert [*zip(got["text"].tolist(), got["item"].tolist(), got["n_match"].tolist())] == [(0, 0, 1000), (1, 1, 150)]
    assert time.process_time() - start < 40
    rows = [(1, "q " + "long " * 30, "x", 1), (1, "q " + "long " * 30, "x", 1), (2, None, None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string, n_match int")
    bench = spark.createDataFrame([(7, "long " * 20, 1)], "item_id long, text string, doc_id int")
    assert [r.doc_id for r in decontam.find(docs, bench).collect()] == [1, 1]
    assert decontam.clean(docs, bench).collect() == [r for r in docs.collect() if r.doc_id == 2]


def test_dense_groups_of_copies(spark, monkeypatch):
    """Very many near copies in every bucket: pieces, leaders and the rest give the links of all pairs."""
    monkeypatch.setattr(jaccard, "PIECE", 16)
    monkeypatch.setattr(jaccard, "SMALL", 4)
    rng = random.Random(3)
    base = prose(rng, 60).split()
    made = []
    for k in range(150):
        w = list(base)
        w[rng.randrange(60)] = f"n{k}"
        made.append((k, " ".join(w)))
    # Half like them: in their buckets, but not linked.
    made += [(500 + k, " ".join(w if i % 12 or rng.random() < 0.3 else f"m{k}x{i}" for i, w in enumerate(base))) for k in range(120)]
    links = linked(made)
    got = {r.doc_id: r for r in jaccard.join(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert [got[i].n_links for i, _ in made] == [len(x) for x in links]
    top = [*range(len(made))]
    for _ in made:
        top = [min([top[i], *(top[j] for j in x)]) for i, x in enumerate(links)]
    least = {}
    for i, g in enumerate(top):
        least[g] = min(least.get(g, made[i][0]), made[i][0])
    assert [got[i].class_id for i, _ in made] == [least[g] for g in top]


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000, 2000 + i) for i in range(400)] + [(5, 5), (None, 7), (8, None), (None, None)] + [(3000 + i, 3001 + i) for i in range(60)]
    got = {r.node: r.comp for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    top = {}

    def root(v):
        while top.setdefault(v, v) != v:
            v = top[v]
        return v

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((root(a), root(b)))
            top[b] = a
    assert got == {v: root(v) for v in top}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quality_bands_against_plain_ratios():
    """The verdict of the method by its own words: ratio of the whole against the limits of its length, then the share of chunks out of band."""
    rng = random.Random(9)
    made = [prose(rng, n) for n in (1, 5, 20, 60, 200, 900, 3000)] + ["ab " * n for n in (10, 100, 3000)] + ["".join(chr(rng.randint(33, 126)) for _ in range(n)) for n in (30, 300, 9000)] + ["", None, prose(rng, 900) + "x " * 6000]
    bands, z = quality.Bands(), zstandard.ZstdCompressor(level=3)
    got = quality.measure(pa.array(made), bands, 20, 30)
    for text, failed, kept in zip(made, got["base_failed"], got["kept"]):
        data = (text or "").encode()
        fits = True
        if data:
            _, least, most = [b for b in bands.whole if b[0] <= len(data)][-1]
            fits = least <= len(z.compress(data)) / len(data) <= most
            chunks = [data[a : a + 4096] for a in range(0, len(data), 4096)] if len(data) > 4096 else []
            chunks = [c for c in chunks if len(c) >= 2048]
            bad = [not 0.20 <= len(z.compress(c)) / len(c) <= 0.75 for c in chunks]
            fits = fits and (not bad or sum(bad) <= len(bad) / 3)
        w = words(text)
        grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        inside = {p for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        assert bool(failed) == (len(w) < 20 or 100 * len(inside) > 30 * len(w))
        assert bool(kept) == (not failed and fits)


def test_packed_rows_with_map_columns(spark):
    rows = [(1, "a b c", "s", {"k": "v"}), (1, "a b c", "s", {"k": "w"}), (2, "d e", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, more map<string,string>")
    assert mixing.mix(docs).columns == docs.columns
    assert quality.keep(docs, min_words=1).where(F.col("doc_id") > 0).count() >= 0


def test_operators_leave_the_session_alone(spark, texts):
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", kit.BATCH_BYTES, kit.CLEAN_UP, "spark.sql.shuffle.partitions")
    was = {n: spark.conf.get(n, None) for n in names}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    html.extract(docs.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html")).count()
    suffix.dedup(docs).count()
    quality.keep(docs).count()
    with pytest.raises(Exception, match="no such"):
        kit.stored(docs.select(F.raise_error(F.lit("no such")).alias("x")))
    assert {n: spark.conf.get(n, None) for n in names} == was


def test_a_common_phrase_costs_its_places():
    """A text that says a phrase of six words over and over, against many items that say it once: nothing to find, little to pay."""
    rng = random.Random(1)
    word = lambda: f"w{rng.randrange(10**6)}"
    phrase = "one two three four five six"
    items = [" ".join([word() for _ in range(rng.randint(8, 20))] + [phrase] + [word() for _ in range(12)]) for _ in range(2000)]
    text = " ".join(phrase + " " + " ".join(word() for _ in range(rng.randint(3, 6))) for _ in range(1500))
    ix = decontam.index([*range(2000)], items)
    start = time.process_time()
    assert len(decontam.matches(pa.array([text]), ix)["text"]) == 0
    assert time.process_time() - start < 8  # every place with every item side by side took 65 s
    whole = text + " " + items[7]
    assert decontam.matches(pa.array([whole]), ix)["item"].tolist() == [7]


def test_chance_hits_are_only_those_that_are_given_up():
    rng = np.random.default_rng(3)
    h, words = (rng.integers(0, 3, n).astype(np.uint64) for n in (400, 300))
    for mask in decontam.MASKS:
        ones = np.flatnonzero(np.array(list(mask)) == "1")
        here, there = np.divmod(np.arange((400 - len(mask)) * (300 - len(mask))), 300 - len(mask))
        hit = (h[here[:, None] + ones] == words[there[:, None] + ones]).all(1)
        here, there = here[hit], there[hit]
        need = np.full(len(here), 12)
        kept = decontam.promising(h, words, here, there, (np.zeros_like(here), np.full_like(here, 400)), (np.zeros_like(here), np.full_like(here, 300)), mask, need)
        gone = decontam.chance(h, words, here, there, mask, need)
        inner = (here >= 12) & (there >= 12) & (here < 370) & (there < 270)
        assert not (gone & kept & inner).any() and gone[inner].any()


def test_report_has_a_row_a_document(spark):
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = " ".join(word() for _ in range(25))
    items = [(k, " ".join(word() for _ in range(4)) + " " + passage) for k in range(40)] + [(99, "another " * 3 + " ".join(word() for _ in range(30))), (100, None)]
    docs = [(k, word() + " " + passage + " " + word()) for k in range(50)] + [(None, items[40][1] + " " + passage), (60, "clean text of no benchmark at all"), (61, None), (7, word() + " " + passage)]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    pairs = decontam.find(*frames).collect()
    for size in (1_000_000, 300):
        got = decontam.report(*frames, block_words=size).collect()
        assert len(got) == 52 and sum(r.n_items for r in got) == len(pairs) == 52 * 40 + 1
        for r in got:
            best = max(p.n_match for p in pairs if p.doc_id == r.doc_id)
            assert r.n_match == best and any((p.doc_id, p.item_id, p.n_match, p.n_span, p.doc_word, p.item_word) == (r.doc_id, r.item_id, r.n_match, r.n_span, r.doc_word, r.item_word) for p in pairs)
    assert decontam.report(frames[0], frames[1].limit(0)).count() == decontam.report(frames[0].limit(0), frames[1]).count() == 0


def test_quality_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "some words", 5, 6, "r")], "doc_id long, text string, __text int, N_Words int, __row string")
    out = quality.judge(docs)
    assert out.columns[:4] == ["doc_id", "text", "__text", "__row"] and [c.lower() for c in out.columns].count("n_words") == 1
    assert (out.first()["__text"], out.first()["n_words"], out.first()["__row"]) == (5, 2, "r")
    assert quality.keep(docs, min_words=1).columns == docs.columns


def quoted(order, edits=0, pairs=20, seed=11):
    """Pairs of documents that share a passage of 60 words, and of each passage all quotations of 9 words, in documents of their own."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**6)}"
    wholes, quotes = [], []
    for k in range(pairs):
        passage = [word() for _ in range(60)]
        for _ in range(2):
            own = [word() if edits and j % edits == edits - 1 else w for j, w in enumerate(passage)]
            wholes.append((k, " ".join([word() for _ in range(30)] + own + [word() for _ in range(30)])))
        for a in range(0, 52, 4):
            quotes.append(" ".join([word() for _ in range(15)] + passage[a : a + 9] + [word() for _ in range(15)]))
    rng.shuffle(quotes)
    at = {"before": lambda i: 10_000 + i, "behind": lambda i: i, "between": lambda i: i * 7}[order]
    docs = [(at(i), t) for i, (_, t) in enumerate(wholes)] + [(1000 + i if order != "between" else i * 2 + 1 if (i * 2 + 1) % 7 else 10_000 + i, t) for i, t in enumerate(quotes)]
    return docs, {at(i) for i in range(len(wholes))}


@pytest.mark.parametrize("order", ["before", "behind", "between"])
def test_passages_behind_many_short_quotations(spark, order):
    docs, wholes = quoted(order)
    assert len({i for i, _ in docs}) == len(docs)
    got = chaining.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(wholes & {r.doc_id for r in got}) >= 0.95 * len(wholes)
    assert {r.doc_id for r in got} <= wholes
    assert all(r.word_from <= 34 and r.word_to >= 86 for r in got)


def test_second_round_over_blocks(spark, monkeypatch):
    docs, wholes = quoted("between")
    monkeypatch.setattr(kit, "BLOCK_BYTES", 3000)
    got = chaining.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(wholes & {r.doc_id for r in got}) >= 0.95 * len(wholes) and {r.doc_id for r in got} <= wholes


def test_passages_of_a_small_table_by_all_pairs(spark):
    """Every document with a passage of 45 words and more that another one holds, found by trying all pairs of places."""
    rng = random.Random(12)
    stock = [[f"p{k}w{j}" for j in range(120)] for k in range(4)]
    docs = []
    for i in range(60):
        words = [f"d{i}x{j}" for j in range(rng.randint(20, 60))]
        for _ in range(rng.randint(0, 3)):
            k, a, n = rng.randrange(4), rng.randrange(60), rng.choice([6, 9, 30, 45, 60])
            at = rng.randrange(len(words))
            words[at:at] = stock[k][a : a + n]
        docs.append((i, " ".join(words)))
    texts = [t.split() for _, t in docs]

    def longest(a, b):
        row, best = [0] * (len(b) + 1), 0
        for x in a:
            row = [0, *((row[j] + 1 if x == y else 0) for j, y in enumerate(b))]
            best = max(best, *row)
        return best

    want = {i for i in range(60) if max(longest(texts[i], texts[j]) for j in range(60) if j != i) >= 45}
    least = {i for i in range(60) if max(longest(texts[i], texts[j]) for j in range(60) if j != i) >= 12}
    got = {r.doc_id for r in chaining.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert want <= got and got <= least


def test_tables_of_any_width_may_be_aligned():
    for n in (10, 900, 1010, 50_000):
        page = f"<table><tr><td>{'a' * n}<td>{'b' * n}<td>c<tr><td>d<td>e<td>f</table>"
        first, second = html.render(page, widest=None).split("\n")
        assert first.index("b") == second.index("e") == n + 2 and first.index("c") == second.index("f") == 2 * n + 4
        assert html.render(page, widest=2 * n + 7) == first + "\n" + second and html.render(page, widest=2 * n + 6).endswith("d  e  f")


def test_rowspan_to_the_end_of_a_section():
    assert html.render("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>").split("\n") == ["a  b", "   c", "   d"]
    assert html.render("<table><tbody><tr><td rowspan=0>a<td>b<tr><td>c<tbody><tr><td>d<td>e</table>").split("\n") == ["a  b", "   c", "d  e"]


def test_depth_is_a_parameter():
    page = "<div>" * 600 + "deep" + "</div>" * 600
    assert html.render(page) == html.render(page, deepest=10) == html.render(page, deepest=10_000) == "deep"


def test_distinct_values_and_their_places():
    """As np.unique, whatever bits the values share."""
    gen = np.random.default_rng(6)
    wide = gen.integers(0, 1 << 63, 4000).astype(np.uint64)
    near = (wide[gen.integers(0, 40, 4000)] & ~np.uint64(255)) + gen.integers(0, 200, 4000).astype(np.uint64)
    whole = np.array([0, (1 << 64) - 1, 5, 0, (1 << 64) - 1, 1 << 63], np.uint64)
    for x in (wide, wide[gen.integers(0, 50, 4000)], near, whole, whole[:1], whole[:0], np.zeros(70, np.uint64), near >> np.uint64(40), np.arange(3000, dtype=np.uint64)[::-1]):
        values, places = kit.distinct(x)
        expected = np.unique(x, return_inverse=True)
        assert values.dtype == np.uint64 and np.array_equal(values, expected[0]) and np.array_equal(places, expected[1])


def test_words_and_their_hashes():
    """Bounds as those of the pattern, text by text; hashes as the sums that they stand for."""
    rng = random.Random(8)
    made = ["", " ", "a", "ab", " a", "a ", "\t\n", "né à", "", *("".join(rng.choice("aB é\n\x0b中\x85.") for _ in range(rng.randint(0, 12))) for _ in range(400))]
    for texts_ in (made, [], [""], ["", ""], ["abc"], ["abc", "def"]):
        t = kit.Texts(pa.array(texts_, pa.string())).words()
        raw = [x.encode() for x in texts_]
        spans = [(i, *m.span()) for i, x in enumerate(raw) for m in re.finditer(rb"[^\x20\x09-\x0D]+", x)]
        lo = t.lo.tolist()
        assert [(d, a - lo[d], b - lo[d]) for d, a, b in zip(t.doc.tolist(), t.ws.tolist(), t.we.tolist())] == spans
        low = kit.lower_ascii(t.buf)
        assert low.tobytes() == b"".join(raw).lower()
        for buf in (t.buf, low):
            sums = [sum((b + 1) * pow(kit._P, j, 1 << 64) for j, b in enumerate(buf[x:y].tobytes())) % (1 << 64) ^ (y - x) * kit._Q % (1 << 64) for x, y in zip(t.ws.tolist(), t.we.tolist())]
            assert np.array_equal(t.hashes(None if buf is t.buf else buf), kit.mix(np.array(sums, np.uint64)))


def test_messages_of_a_block_share_their_packer(monkeypatch):
    """What a message costs besides its bytes grows with the number of buckets; nothing is set up anew for each."""
    made = Counter()
    for name in ("ZstdCompressor", "ZstdDecompressor"):
        kind = getattr(zstandard, name)
        monkeypatch.setattr(zstandard, name, lambda *a, kind=kind, name=name, **b: made.update([name]) or kind(*a, **b))
    rng = random.Random(9)
    docs = pa.table({"doc_id": [1], "__text": [prose(rng, 4000)], "__block": pa.array([0]), "__held": [False]})
    asked = lm._ask(docs, lm.NONE, 200)
    assert asked.num_rows > 100
    for i in range(asked.num_rows):
        lm._merge(asked.slice(i, 1))
    assert sum(made.values()) <= 4, made


def test_spelling_by_table_or_search(monkeypatch):
    gen = np.random.default_rng(7)
    kinds, n = np.unique(gen.integers(0, 1 << 24, 3000) & 0x3F3F3F, return_counts=True)
    asked = np.concatenate([kinds, gen.integers(0, 1 << 24, 3000)])
    for rows in (lm.LOOKUP, 0):
        monkeypatch.setattr(lm, "LOOKUP", rows)
        x = lm.Spelling(kinds, n, 0)
        assert np.array_equal(x.log10(asked), x.searched(asked)) and np.array_equal(x.log10(kinds), x.searched(kinds)) and not len(x.log10(kinds[:0]))
    empty = lm.Spelling(kinds[:0], n[:0], 0)
    assert np.allclose(empty.log10(asked), np.log10(1 / 256))


def test_stages_work_on_small_pieces(spark, monkeypatch):
    """However large the batch, a Python worker of the pipeline's stages holds little beside it."""
    runs, trimmed = [], kit.trimmed
    monkeypatch.setattr(kit, "trimmed", lambda run, own=None: runs.append(run) or trimmed(run, own))
    docs, bench = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(50)))], "item_id long, text string")
    made = [lambda: quality.keep(docs), lambda: jaccard.describe(docs), lambda: decontam.clean(docs, bench), lambda: tokens.write(docs, queries.tokenizer_path(), 2, kit.scratch(spark))]
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(400)) for _ in range(1000)]
    n = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([n, n, n, n, n, pa.array(texts)], names=["__row", "doc_id", "tkey", "__key", "__tie", "__text"])
    assert batch.column(5).nbytes > 2 << 20
    for make in made:
        runs.clear()
        make()
        assert sum(x.num_rows for x in runs[0](iter([batch.slice(0, 9)]))) == 9  # tables that are kept
        tracemalloc.start()
        assert sum(x.num_rows for x in runs[0](iter([batch]))) == len(texts)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        print(runs[0].__module__, peak >> 20)
        assert peak < 20 << 20
