"""Each operator against a brute-force version, and on odd input: nulls, empty and long texts, ties, repeated rows, no rows, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cloakframe.llm import chaining, decontam, html, jaccard, kit, lm, mixing, quality, queries, suffix, tokens, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, cid long, score double"


def words(text):
    return re.findall(kit.WORD, text or "")


def prose(rng, n):
    return " ".join("".join(rng.choice(["an", "re", "th", "er", "on", "é", "ti", "sh"]) for _ in range(rng.randint(1, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [prose(rng, rng.randint(30, 120)) for _ in range(20)]
    passage = prose(rng, 70)
    texts = base + [base[0], base[1] + " end", None, "", " \n\t ", "one", "one two", "one two", passage + " " + base[2], base[3] + " " + passage, "be " * 400, "x" * 5000, "é" * 300, prose(rng, 6000)]
    texts += [" ".join(w if i % 19 else "changed" for i, w in enumerate(base[4].split()))]
    out = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), 5, None, 1, 0.5) for i, t in enumerate(texts)]
    return out + [out[0], out[0], (None, base[5], None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_and_hashes():
    texts = ["a  b c", "", None, "\n x\x0by\x1cz "]
    t = kit.Texts(pa.array(texts)).words()
    got = [[t.buf[a:b].tobytes().decode() for a, b in zip(t.ws[i:j], t.we[i:j])] for i, j in zip(t.first[:-1], t.first[1:])]
    assert got == [words(x) for x in texts]
    u = kit.Texts(pa.array(["zz a", "a a"])).words()
    h = u.hashes()
    assert h[1] == h[2] == h[3] != h[0]


def test_html():
    page = """<html><head><title>no</title><style>p{}</style></head><body><p>one<p>two <b>bold</b>!<ul><li>a<ol start=3><li>x<li>y</ol><li>b</ul>
<table><tr><th>Name<th>N<tr><td>alpha<td>1<tr><td colspan=2>wide</table><div hidden>no</div><p style="display: none">no</p><span style="visibility:hidden">no<i style="visibility:visible">yes</i></span>
<pre>a
  b</pre>x<br>y&amp;z<!-- no --><script>var a = "</p>";</script><details><summary>S</summary>no</details>"""
    text = html.render(page)
    assert text == "one\n\ntwo bold!\n\n- a\n  3. x\n  4. y\n- b\n\nName   N\nalpha  1\nwide\n\nyes\n\na\n  b\n\nx\ny&z\nS"
    assert html.render(None) == html.render("") == html.render("<p>") == ""
    assert html.render("<div>" * 5000 + "deep") == "deep"
    assert html.render("<b><a href='x") == "<a href='x" or "x" in html.render("<b><a href='x")


@pytest.mark.parametrize("broken", ["<", "<<p>a", "<p <b>x", "</p>x", "<table>a<td>b", "<!x", "<li>x", "&#0;&bogus;"])
def test_html_broken(broken):
    assert isinstance(html.render(broken), str)


def test_html_words_match_a_plain_parser(spark, sf):
    """On the driver's pages, which hide nothing but head and script, the visible words are those of a plain parser."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.skip = [], 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("title", "style", "script")
            self.out.append(" " if tag not in ("b", "a", "i") else "")

        def handle_endtag(self, tag):
            self.skip -= tag in ("title", "style", "script")
            self.out.append(" " if tag not in ("b", "a", "i") else "")

        def handle_data(self, data):
            self.out.append("" if self.skip else data)

    pages = spark.read.parquet(f"{sf}/pages.parquet").limit(40)
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    for r in pages.collect():
        p = Plain()
        p.feed(r.html)
        plain = [w for w in "".join(p.out).split()]
        assert [w for w in got[r.page_id].split() if w != "-"] == [w for w in plain if w != "-"]


@pytest.mark.parametrize(
    "page, text",
    [
        ("<table><form><tr><td>Hello<td>you</td></tr></form><tr><td>a<td>b</table>end", "Hello  you\na      b\n\nend"),
        ("<table><tr><form action=x><td>x</td></form><td>y</tr></table>", "x  y"),
        ("<table><tr><div>x</div><td>y</tr></table>", "x\n\ny"),
        ("<table><tbody><tr><td>a</td><p>b<p>c<td>d<tr><td>e</table>", "b\n\nc\n\na  d\ne"),
        ("<table><tr><td>o<table><tr><div>i</div><td>j</table></table>", "o\ni\nj"),
        ("<table><tr><table><tr><td>in</table><tr><td>out</table>", "in\n\nout"),
        ("<table><tr><input type=submit value=Go><textarea>t</textarea><td>x</table>", "Got\n\nx"),
        ("<table><colgroup><col><div>x</div><tr><td>y</table>", "x\n\ny"),
    ],
)
def test_html_elements_between_cells(page, text):
    assert html.render(page) == text


def test_html_stray_quotes():
    assert html.render("<p title=it's>First</p> don't <b>go</b>") == "First\n\ndon't go"
    assert html.render("""<p title = "a>b" class='c>d'>x</p>y""") == "x\n\ny"
    assert html.render("<p ' >x</p> it's <b>y</b>") == "x\n\nit's y"
    assert html.render("<p title=it's hidden>x</p>y") == "y"
    assert html.Node("a", " x=it's y=2").get("x") == "it's"


def test_html_on_odd_tables(spark):
    schema = "page_id long, url string, html string, text string, n_lines int"
    odd = spark.createDataFrame([(1, None, None, "x", 3), (None, "u", "<p>a", None, None), (1, None, "", None, 1), (1, None, "<p>" + "b " * 200_000, None, 1)], schema)
    got = [(r.page_id, r.text[:3], r.n_lines) for r in html.extract(odd).collect()]
    assert sorted(got, key=str) == sorted([(1, "", 0), (None, "a", 1), (1, "", 0), (1, "b b", 1)], key=str)
    assert html.extract(spark.createDataFrame([], schema)).count() == 0


def test_urls(spark):
    assert urls.split("HTTP://A.Com:80/x?y#z") == ("a.com:80", "/x") and urls.split(None) == urls.split("nothing") == ("", "")
    rng = random.Random(2)
    hosts = ["com", "a.com", "b.a.com", "xa.com", "org", "c.org", "", "net"]
    paths = ["/", "/a", "/a/b", "/ab", ""]
    rules = [(h, p, rng.choice(["block", "allow"])) for h in hosts if h for p in paths if rng.random() < 0.6]
    made = [(i, rng.choice([None, "x"]) if rng.random() < 0.05 else f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q', '#f', 'c'])}") for i in range(600)]
    made += [(1000 + i, "http://b.a.com/a") for i in range(300)] + [made[0]] * 2

    def best(url):
        h, p = urls.split(url)
        fits = [(len(a + b), len(a), a + b, v) for a, b, v in rules if (h == a or h.endswith("." + a)) and p.startswith(b)]
        return max(fits)[2:] if fits else (None, "allow")

    out = urls.judge(spark.createDataFrame(made, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string"), ranges=7).collect()
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in out)) == sorted((i, *urls.split(u), *best(u)) for i, u in made)
    empty = spark.createDataFrame([], "host string, path string, verdict string")
    assert urls.judge(spark.createDataFrame(made[:3], "page_id long, url string"), empty).where("rule is not null").count() == 0
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), empty).count() == 0


def test_quality(spark, docs, rows, none):
    got = Counter(tuple(r) for r in quality.judge(docs, keep_columns=["doc_id"]).select("doc_id", *quality.STATS, "base_failed").collect())
    expected = Counter()
    for i, text, *_ in rows:
        w, t = words(text), text or ""
        grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        inside = {p for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        lines = [x for x in t.split("\n") if words(x)]
        expected[(i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside), len(w) < 20 or 100 * len(inside) > 30 * len(w))] += 1
    assert got == expected
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= set(range(20))
    assert quality.keep(none).count() == quality.judge(none).count() == 0
    # Repetition that no repeated window of words shows, and noise, are out of band; prose is not.
    rng = random.Random(1)
    noise = "".join(chr(rng.randint(33, 126)) for _ in range(9000))
    t = kit.Texts(pa.array(["ab" * 3000, noise, prose(rng, 900)]))
    whole, share = quality.ratios(t, quality.Bands())
    assert quality.in_band(t.hi - t.lo, whole, share, quality.Bands()).tolist() == [False, False, True]


def test_mixing_plan(docs, rows, none):
    got = mixing.plan(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, text, _, source, *_ in rows:
        sizes[source] += len(words(text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = dict(zip(order, [3, 1, 2, 3]))
    goal, left, open_ = {}, 1.5 * sum(sizes.values()), list(order)
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if share * weight[s] > 2 * sizes[s]]
        for s in full or open_:
            goal[s] = 2 * sizes[s] if full else share * weight[s]
        left -= sum(goal[s] for s in full)
        open_ = [s for s in open_ if s not in goal]
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - goal[r.source]) < 1e-6 and 0 <= r.times <= 2 and r.taken == r.times * r.size
        taken[r.source] += r.taken
    for s in order:
        own = [len(words(t)) for _, t, _, source, *_ in rows if source == s]
        passes = min(2, int(goal[s] // max(1, sum(own))))
        sums = {0}
        for n in own:
            sums |= {x + n for x in sums}
        assert abs(taken[s] - goal[s]) <= min(abs(passes * sum(own) + x - goal[s]) for x in sums) + 1
    assert sorted(map(str, got)) == sorted(map(str, mixing.plan(docs).collect()))
    assert mixing.plan(none).count() == mixing.mix(none).count() == 0
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and sum(len(words(r.text)) for r in mixed.collect()) == sum(taken.values())


def test_mixing_subset():
    rng = np.random.default_rng(3)
    for _ in range(200):
        lengths = np.unique(rng.integers(1, 30, rng.integers(1, 6)))
        counts = rng.integers(0, 4, len(lengths))
        goal = int(rng.integers(0, 120))
        sums = {0}
        for n, c in zip(lengths, counts):
            sums = {s + k * int(n) for s in sums for k in range(c + 1)}
        got = mixing.subset(lengths, counts, goal)
        assert (got <= counts).all() and abs(int((got * lengths).sum()) - goal) == min(abs(s - goal) for s in sums)
        whole = mixing.fit(lengths, counts, min(goal, int((lengths * counts).sum())))
        assert (whole <= counts).all() and (whole >= 0).all()


def brute_suffix(rows, length):
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = Counter(e[a : a + length] for _, e in texts for a in range(len(e) - length + 1))
    out = Counter()
    for i, e in texts:
        gone = bytearray(len(e))
        for a in range(len(e) - length + 1):
            if seen[e[a : a + length]] > 1:
                gone[a : a + length] = b"\1" * length
        kept = bytes(x for x, g in zip(e, gone) if not g)
        spans = sum(gone[k] and (k == 0 or not gone[k - 1]) for k in range(len(e)))
        out[(i, len(e), sum(gone), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize(("length", "hot", "local", "block"), [(200, 4096, 1024, 3 << 20), (200, 2, 1024, 5000), (200, 1, 1, 20000), (37, 4096, 2, 4000), (6, 3, 1024, 9000)])
def test_suffix(docs, rows, none, monkeypatch, length, hot, local, block):
    """With few stretches a hash, so that hashes are split again and again, results are the same."""
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "LOCAL", local)
    monkeypatch.setattr(kit, "BLOCK_BYTES", block)
    for sample, seen in ((256, 8), (1, 2), (2, 1)):  # hashes that are split from the start: none, many
        monkeypatch.setattr(suffix, "SAMPLE", sample)
        monkeypatch.setattr(suffix, "SEEN", seen)
        assert Counter(tuple(r) for r in suffix.dedup(docs, length).collect()) == brute_suffix(rows, length)
    assert suffix.dedup(none).count() == 0


def test_transform():
    rng = np.random.default_rng(0)
    for _ in range(150):
        length = int(rng.integers(2, 30))
        parts = [rng.integers(1, rng.integers(2, 6), int(rng.integers(1, 90))).astype(np.uint8) for _ in range(int(rng.integers(1, 7)))]
        text = np.concatenate([np.append(p, np.uint8(0)) for p in [*parts, parts[0]]])
        hit = suffix.repeated(text, length)
        pieces = [(i, text[i : i + length].tobytes()) for i in range(len(text) - length + 1)]
        seen = Counter(w for _, w in pieces)
        assert all(hit[i] == (seen[w] > 1) for i, w in pieces if 0 not in w)


def linked(rows):
    def shingles(t):
        w = words(t)
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingles(r[1]) for r in rows]
    return [[j for j, b in enumerate(sets) if i != j and a and b and 5 * len(a & b) >= 4 * len(a | b)] for i, a in enumerate(sets)]


@pytest.mark.parametrize(("piece", "small"), [(1024, 48), (2, 0)])
def test_jaccard(spark, rows, none, monkeypatch, piece, small):
    monkeypatch.setattr(jaccard, "PIECE", piece)
    monkeypatch.setattr(jaccard, "SMALL", small)
    rng = random.Random(9)
    base = prose(rng, 200).split()
    more = []
    for k in range(14):
        w = list(base)
        for _ in range(k):
            w[rng.randrange(200)] = f"new{k}"
        more.append((500 + k, " ".join(w), *([None] * 7)))
    all_rows = rows + more
    docs = spark.createDataFrame(all_rows, SCHEMA)
    links = linked(all_rows)
    got = jaccard.join(docs).collect()
    assert Counter((r.doc_id, r.n_links) for r in got) == Counter((r[0], len(x)) for r, x in zip(all_rows, links))
    top = list(range(len(all_rows)))

    def root(v):
        while top[v] != v:
            v = top[v]
        return v

    for i, x in enumerate(links):
        for j in x:
            a, b = root(i), root(j)
            top[max(a, b)] = min(a, b)
    groups = {}
    for i, r in enumerate(all_rows):
        groups.setdefault(root(i), []).append(r[0])
    least = Counter((d, min((x for x in g if x is not None), default=None)) for g in groups.values() for d in g)
    assert Counter((r.doc_id, r.class_id) for r in got) == least
    kept = jaccard.dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert jaccard.join(none).count() == jaccard.dedup(none).count() == 0


def test_jaccard_pruning_is_safe():
    """A pair at the threshold passes every step but with the chance that the tolerance and the number of hashes allow."""
    rng = np.random.default_rng(4)
    lost = 0
    for _ in range(300):
        common = rng.integers(0, 1 << 63, 80, dtype=np.uint64)
        a, b = (np.sort(np.concatenate([common, rng.integers(0, 1 << 63, 10, dtype=np.uint64)])) for _ in range(2))
        sig = jaccard.signatures(np.concatenate([a, b]), np.array([0, 90, 180]))
        lost += not [*jaccard.surviving(sig[:1], sig[1:], False)]
    assert lost == 0


def test_chaining(spark, none):
    rng = random.Random(7)
    passage = prose(rng, 60).split()
    fuzzy = [w if i % 17 else "other" for i, w in enumerate(passage)]
    made = [(1, prose(rng, 50) + " " + " ".join(passage) + " " + prose(rng, 40)), (2, prose(rng, 90) + " " + " ".join(passage)), (3, " ".join(fuzzy) + " " + prose(rng, 80)), (4, prose(rng, 200)), (5, None), (6, ""), (7, "a b c"), (8, prose(rng, 20) + " " + " ".join(passage[:25])), (9, "be " * 300)]
    made += [(20 + k, " ".join(passage) + f" {prose(rng, 30)}") for k in range(30)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    for size in (3 << 20, 2000):
        kit.BLOCK_BYTES = size
        got = {}
        for r in chaining.passages(docs).collect():
            got.setdefault(r.doc_id, []).append(r)
        kit.BLOCK_BYTES = 3 << 20
        assert set(got) == {1, 2, 3, *range(20, 50)}
        for i, at in ((1, 50), (2, 90), (3, 0), (20, 0)):
            (r,) = got[i]
            assert abs(r.word_from - at) <= 3 and abs(r.word_to - at - 60) <= 3 and r.other_id in got and r.other_id != i
        assert sum(r.first for x in got.values() for r in x) >= 1
    assert chaining.passages(none).count() == 0


def test_chaining_finds_edited_passages(spark):
    """Passages with a word replaced in every 6 to 8, and with 10 to 20% of the words replaced at random."""
    rng = random.Random(17)
    edits = [lambda n, k=k: [i % k == k - 1 for i in range(n)] for k in (6, 7, 8)] + [lambda n, p=p: [rng.random() < p for _ in range(n)] for p in (0.1, 0.15, 0.2)]
    made, n = [], 25
    for e, edit in enumerate(edits):
        for i in range(n):
            passage = prose(rng, 60).split()
            other = [f"edit{rng.random()}" if hit else w for w, hit in zip(passage, edit(60))]
            made += [(1000 * e + 2 * i, f"{prose(rng, 30)} {' '.join(passage)} {prose(rng, 30)}"), (1000 * e + 2 * i + 1, f"{prose(rng, 45)} {' '.join(other)} {prose(rng, 15)}")]
    found = Counter(r.doc_id // 1000 for r in chaining.passages(spark.createDataFrame(made, "doc_id long, text string")).collect() if r.other_id == r.doc_id ^ 1)
    recall = [found[e] / (2 * n) for e in range(len(edits))]
    assert recall[:3] == [1, 1, 1] and min(recall[3:5]) >= 0.95 and recall[5] >= 0.85, recall


def test_chain_is_best():
    """The Fenwick chain scores as well as the best chain found by trying all pairs."""
    rng = random.Random(8)
    for _ in range(100):
        segs = [(rng.randint(0, 200), rng.randint(0, 200), rng.randint(5, 20)) for _ in range(rng.randint(1, 9))]
        segs = list(dict.fromkeys(segs))
        x, y, n = zip(*segs)
        trim = min(chaining.K // 2, (min(n) - 1) // 2)
        order = sorted(range(len(segs)), key=lambda i: x[i])
        best = [0.0] * len(segs)
        for i in order:
            before = [best[j] - chaining.GAP_COST * (x[i] + y[i] + 2 * trim - x[j] - n[j] - y[j] - n[j] + 2 * trim) for j in order if x[j] + n[j] - trim <= x[i] + trim and y[j] + n[j] - trim <= y[i] + trim and j != i]
            best[i] = n[i] + max([0.0, *before])
        got = chaining.chain(list(x), list(y), list(n))[0]
        score = n[got[0]] + sum(n[i] - chaining.GAP_COST * (x[i] + y[i] + 2 * trim - x[j] - n[j] - y[j] - n[j] + 2 * trim) for j, i in zip(got, got[1:]))
        assert abs(score - max(best)) < 1e-9
    assert chaining.common([1, 2, 3, 4], [2, 4, 5]) == 2 and chaining.common([], [1]) == 0


def test_decontamination(spark, none):
    rng = random.Random(3)
    items = [(k, prose(rng, 20 + k)) for k in range(6)] + [(90, "one two"), (91, None), (92, "")]
    w = items[3][1].split()
    changed = " ".join(x if i not in (7, 15) else "changed" for i, x in enumerate(w))
    made = [(1, prose(rng, 100)), (2, prose(rng, 30) + " " + items[2][1].upper() + ". " + prose(rng, 9)), (3, changed + " " + prose(rng, 40)), (4, " ".join(w[:8])), (5, None), (None, items[0][1]), (7, items[1][1]), (7, items[1][1]), (8, "one two")]
    docs, bench = spark.createDataFrame(made, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    expected = Counter([(2, 2), (3, 3), (None, 0), (7, 1), (7, 1), (8, 90)])
    for size in (1_000_000, 25):
        assert Counter((r.doc_id, r.item_id) for r in decontam.find(docs, bench, block_words=size).collect()) == expected
        assert sorted(str(r.doc_id) for r in decontam.clean(docs, bench, block_words=size).collect()) == ["1", "4", "5"]
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find(docs, nothing).count() == 0 and decontam.clean(docs, nothing).count() == len(made)
    assert decontam.clean(none, bench).count() == decontam.find(none, bench).count() == 0


def test_masks_tolerate_substitutions():
    """Of 13 words with any two changed, some mask hits at some place."""
    from itertools import combinations

    for lost in combinations(range(13), 2):
        equal = [i not in lost for i in range(13)]
        assert any(all(equal[a + j] for j, c in enumerate(m) if c == "1") for m in decontam.MASKS for a in range(13 - len(m) + 1))


@pytest.mark.parametrize("vocabulary", [2, 300, 50_257, 65_536, 70_000])
def test_packing(vocabulary):
    ids = np.random.default_rng(0).integers(0, vocabulary, 9001).astype(np.uint32)
    bounds = np.array([0, 0, 10, 4096, 9001])
    r = tokens.Reader(tokens.pack(ids, bounds, vocabulary, 512))
    assert r.width == max(1, (vocabulary - 1).bit_length()) and (r.ids(0, 9001) == ids).all()
    for lo, hi in ((0, 1), (511, 513), (4000, 8200), (9000, 9001), (5, 5)):
        assert (r.ids(lo, hi) == ids[lo:hi]).all()
    assert len(r.document(0)) == 0 and (r.document(2) == ids[10:4096]).all()
    with pytest.raises(ValueError):
        tokens.pack(np.array([1 << 20], np.uint32), np.array([0, 1]), 300)


def test_tokens(spark, docs, rows, none, tmp_path):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)
    odd = ["", None, " a  b", "a b<|endoftext|> c d", "a <|endoftext|> c", "it's  don't 12 3\n\n q \n", "　a b", "a\tb c  d e\u0085 f", " ", "a ", "é è  ù 中文 字 。a", "a  b"]
    rng = random.Random(1)
    odd += ["".join(rng.choice(" \t\n  ab'sé中1!\x7f\x85Ġ ") for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    ids, b = tokens.encode(pa.array(odd), path, 2)
    for k, e in enumerate(tok.encode_batch([x or "" for x in odd], add_special_tokens=False)):
        assert ids[b[k] : b[k + 1]].tolist() == [*e.ids, 2]
    files = tokens.write(docs, path, 2, str(tmp_path / "a"), shard_ids=3000)
    got = tokens.read(files).collect()
    enc = {r[1]: [*tok.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in rows}
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((r[0], len(enc[r[1]]), crc(enc[r[1]])) for r in rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    plain = tokens.export(files, str(tmp_path / "out"))
    assert sum(tokens.Reader(open(p, "rb").read()).n for p in plain) == at
    assert tokens.read(tokens.write(none, path, 2, str(tmp_path / "b"))).count() == 0


def test_lm(spark, docs, rows, none, sf):
    got = lm.score(docs).collect()
    tok = lambda t: ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words(t)] + ["\n"]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    c = Counter(w for i, t, *_ in rows if not held(i) for w in tok(t))
    n, v = sum(c.values()), len(c)
    expected = Counter((i, held(i), len(tok(t)), sum(c[w] > 0 for w in tok(t)), n, round(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tok(t)), 5)) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == expected
    assert all(r.score < 0 and np.isfinite(r.score) for r in got)
    assert lm.score(none).count() == 0
    only = spark.createDataFrame([(i, "ab") for i in range(100) if held(i)], "doc_id long, text string")
    # Two bytes and the end of the word, then the end of the text, each of probability 1/256.
    assert {(r.train_tokens, round(r.score, 5)) for r in lm.score(only).collect()} == {(0, round(4 * np.log10(1 / 256), 5))}
    again = lm.score(docs).collect()
    key = lambda r: (str(r.doc_id), r.n_tokens, round(r.score, 6))
    assert sorted(map(key, got)) == sorted(map(key, again))


@pytest.mark.parametrize("table", ["sf0.01", "sf0.1"])
def test_lm_predicts_held_out_text(spark, monkeypatch, table):
    """Held-out text is less surprising than under word counts alone, on little text too; the same in any number of blocks, and nearly so with frequent words spread."""
    docs = spark.read.parquet(f"/root/testdata/{table}/documents.parquet")
    rows = {r.doc_id: r for r in lm.score(docs).collect()}
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    if table == "sf0.01":
        monkeypatch.setattr(kit, "BLOCK_BYTES", 100_000)
        split = lm.score(docs).collect()
        assert all(abs(r.score - rows[r.doc_id].score) < 1e-4 for r in split)
        spread = lm.score(docs, hot_from=500).where("held_out").collect()
        assert sum(r.score for r in spread) == pytest.approx(sum(r.score for r in held), rel=0.005)


def test_seating_is_drawn_from_the_restaurant_process():
    """Numbers of tables against all seatings of a few customers, counted one by one."""
    for c, d, p, others in ((2, 0.75, 0.2, 3.0), (7, 0.5, 0.02, 40.0), (11, 0.75, 0.3, 5.0)):
        weight = {1: (1 + d * others) * p}
        for n in range(1, c):  # customer n + 1 takes a seat at a table, or a new one
            new = Counter()
            for t, w in weight.items():
                new[t] += w * (n - d * t)
                new[t + 1] += w * (1 + d * (others + t)) * p
            weight = new
        draws = 100_000
        got = lm.seat(np.full(draws, c), np.ones(draws, np.int64), np.full(draws, others + 1), np.full(draws, p), d, 1.0, np.arange(draws, dtype=np.uint64), 5)
        share = np.bincount(got, minlength=c + 1)[1:] / draws
        assert np.allclose(share, [weight[t] / sum(weight.values()) for t in range(1, c + 1)], atol=0.006)
    # The law for many customers goes on where the table ends.
    t = np.array([1, 5, 40, 200])
    near, far = lm.step(np.full(4, lm.TOP), t, 0.75), lm.step(np.full(4, lm.TOP + 1), t, 0.75)
    assert np.allclose(near, far, atol=0.02)


def test_lm_against_a_plain_sampler(spark):
    """On a small table the probabilities are those of a model whose customers move one at a time."""
    rng, gen = random.Random(4), random.Random(1)
    made = [(i, " ".join(rng.choice(["aa", "bb", "cc", "dd"]) for _ in range(rng.randint(3, 12)))) for i in range(60)]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    (d1, s1), (d0, s0) = lm.PAIR, lm.WORD
    names = ["", "aa", "bb", "cc", "dd"]  # the end is spelt as nothing
    pairs = {i: [*zip(["", *t.split()], [*t.split(), ""])] for i, t in made}
    spelt = [lm.letters(np.array([len(w)]), np.frombuffer(w.encode(), np.uint8))[0] for w in names]
    kinds, n = np.unique(np.concatenate(spelt), return_counts=True)
    spelling = lm.Spelling(kinds, n, 0)
    base = {w: 10 ** spelling.log10(k).sum() for w, k in zip(names, spelt)}
    low, up = {w: [] for w in names}, {u: {w: [] for w in names} for u in names}  # sizes of tables
    tables = lambda x: sum(map(len, x.values()))
    customers = lambda x: sum(map(sum, x.values()))

    def p0(w):
        return (sum(low[w]) - d0 * len(low[w]) + (s0 + d0 * tables(low)) * base[w]) / (s0 + customers(low))

    def sit(sizes, d, fresh):
        """Whether the customer opens a table."""
        k = gen.choices(range(len(sizes) + 1), [x - d for x in sizes] + [fresh])[0]
        if k < len(sizes):
            sizes[k] += 1
        else:
            sizes.append(1)
        return sizes[k] == 1

    def leave(sizes):
        k = gen.choices(range(len(sizes)), sizes)[0]
        sizes[k] -= 1
        return not sizes[k] and not sizes.pop(k)

    def come(u, w):
        if sit(up[u][w], d1, (s1 + d1 * tables(up[u])) * p0(w)):
            sit(low[w], d0, (s0 + d0 * tables(low)) * base[w])

    seen = [p for i, x in pairs.items() if not held(i) for p in x]
    for p in seen:
        come(*p)
    sums = Counter()
    for sweep in range(250):
        for u, w in seen:
            if leave(up[u][w]):
                leave(low[w])
            come(u, w)
        if sweep >= 50:
            for u in names:
                for w in names:
                    sums[u, w] += (sum(up[u][w]) - d1 * len(up[u][w]) + (s1 + d1 * tables(up[u])) * p0(w)) / (s1 + customers(up[u])) / 200
    plain = {i: sum(np.log10(sums[p]) for p in x) for i, x in pairs.items()}
    assert all(abs(got[i] - plain[i]) < 0.08 * len(x) for i, x in pairs.items())
    assert sum(got.values()) == pytest.approx(sum(plain.values()), rel=0.005)


def test_token_pieces_end_at_signs_and_lines():
    """A word is one piece whatever sign follows it, and the ids are those of whole texts."""
    import random

    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    words = [f"w{i:x}rd" for i in range(200)]
    tokens.forget()
    tokens.encode(pa.array([" ".join(f"{w}{sign}" for w in words) + "." for sign in ("", ",", ".", "!?", "'s", ".\nSt", "###", ")")]), path, 2)
    assert len(tokens.encoder(path).key) < 2 * len(words)
    tok, rng = Tokenizer.from_file(path), random.Random(5)
    bits = ["a", "word", "Zoë", "é", "×", "÷", "ß", "9", "42", "'", "'s", "'ll", "'tis", ",", "...", "<|", "endoftext", "|>", "<|endoftext|>", " ", "  ", "\n", "\n\n", "\r\n", "\t", "\u00a0", "\u2003", "\u0301", "\u4e2d", "\U0001f600", "\x1c", "\x85", "_", "ª"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(4000)]
    for some in (texts, [t for t in texts if "<|endoftext|>" not in t]):
        tokens.forget()
        ids, b = tokens.encode(pa.array(some), path, 2)
        for t, lo, hi in zip(some, b[:-1].tolist(), b[1:].tolist()):
            assert ids[lo:hi].tolist() == [*tok.encode(t, add_special_tokens=False).ids, 2], repr(t)


def test_chaining_index():
    rng = np.random.default_rng(3)
    for n, kinds in ((0, 1), (1, 1), (3000, 7), (3000, 900), (3000, 1 << 40)):
        seed = rng.integers(0, kinds, n).astype(np.uint64)
        doc = np.sort(rng.integers(0, 60, n))
        pos = np.arange(n)
        assert (chaining.in_order(seed) == np.argsort(seed, kind="stable")).all()
        index, held = chaining.Index(seed, doc, pos), {}
        for s, d, p in zip(seed.tolist(), doc.tolist(), pos.tolist()):
            held.setdefault(s, {}).setdefault(d, p)
        want = [(s, d, p) for s in sorted(held) for d, p in list(held[s].items())[:2]]
        assert list(zip(index.seed.tolist(), index.text.tolist(), index.pos.tolist())) == want
        names = sorted(held)
        assert [names[r] for r in index.rank.tolist()] == seed.tolist() and [names[r] for r in index.number.tolist()] == index.seed.tolist()


def test_chaining_aligns_from_what_the_block_noted(monkeypatch):
    """Seeds are hashed and chained once less: the last step has its chains from the block itself, and reads no answers of buckets."""
    passage = " ".join(f"p{i}" for i in range(60))
    texts = {0: [(1, f"a b c {passage} d e")], 1: [(2, f"x {passage} y z"), (3, "other words")]}
    blocks = {b: pa.table({"doc_id": pa.array([i for i, _ in r], pa.int64()), "__text": [t for _, t in r], "__block": pa.array([b] * len(r), pa.int32())}) for b, r in texts.items()}

    def sent(tables, to):
        t = pa.concat_tables(tables)
        return t.filter(pa.array(t["target"].to_numpy() == to))

    told = [chaining._tell(d, 1) for d in blocks.values()]
    told = [chaining._answer(sent(told, 0))]
    asked = [chaining._ask(d, sent(told, b), 1) for b, d in blocks.items()]
    served = [chaining._serve(d, sent(asked, b), chaining.MSG) for b, d in blocks.items()]
    monkeypatch.setattr(chaining, "Seeds", None)
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("word_from", "word_to", "n_equal")), ("other_id", pa.int64()), ("first", pa.bool_())])
    got = [r for b, d in blocks.items() for r in chaining._finish(d, sent(served, b), schema).to_pylist()]
    assert sorted((r["doc_id"], r["word_from"], r["word_to"], r["n_equal"], r["other_id"], r["first"]) for r in got) == [(1, 3, 63, 60, 2, True), (2, 1, 61, 60, 1, False)]
