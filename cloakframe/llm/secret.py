"""Secret scans: one deterministic automaton for all rules.

The expressions of all rules are compiled together: an automaton of their
reversals, made deterministic by subset construction over classes of bytes,
minimised, and laid out as transition arrays.  One pass over the bytes of a
text, from its end, tells at every byte which rules have a match that begins
there.  From the first such byte of a rule its own automaton, made the same
way, walks to the longest end, and the next match begins at that end or later.
So matches are leftmost, longest, and do not overlap within a rule, whatever
its expression; walks cover matches only.

Expressions know literals, classes, dots, groups, alternatives and repetition
(? * + {m} {m,} {m,n}), over ASCII; a dot is any byte but \\n.  A counted
repetition of a wide class multiplies states; where a fixed beginning makes
matches rare, give a least length instead.

Defined cases: a null text is empty and has no span; offsets are code points,
the end exclusive; rows equal in text have equal spans; all columns of the
input stay, but for those that a result column replaces, whatever their case;
ids are not looked at; an empty table gives an empty one.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakframe.llm import kit


@dataclass(frozen=True)
class Rule:
    """Matches are those of lead and body together; one whose part behind the lead has fewer than `least` bytes is dropped."""

    kind: str
    lead: str
    body: str
    least: int = 0
    fold: bool = False  # letters in either case


#: Fixed values of the contract.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", 6, True),
    Rule("access", "AKIA", r"[A-Z0-9]+", 16),
    Rule("hex", "", r"[0-9a-f]{24,}"),
)
#: Shapes of keys that services publish, and places that hold credentials.
MORE = (
    Rule("github", r"gh[pousr]_", r"[A-Za-z0-9]+", 30),
    Rule("slack", r"xox[abeoprs]-", r"[A-Za-z0-9-]+", 10),
    Rule("stripe", r"[sr]k_(live|test)_", r"[A-Za-z0-9]+", 16),
    Rule("google", "AIza", r"[A-Za-z0-9_-]+", 35),
    Rule("jwt", "", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("pem", "", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
    Rule("bearer", r"bearer\x20+", r"[A-Za-z0-9._~+/=-]+", 20, True),
    Rule("login", r"://[A-Za-z0-9._%+-]*:", r"[A-Za-z0-9!$%&*+,.;=_~-]+@[A-Za-z0-9]", 6),
)
RULES = BASE + MORE

# A tree of an expression: ("set", bytes), ("cat", parts), ("or", parts), ("rep", part, least, most or None).
_ANY = frozenset(range(256)) - {10}
_SPECIAL = {"n": 10, "t": 9, "r": 13, "f": 12, "v": 11}


def parse(pattern: str, fold: bool = False) -> tuple:
    """The tree of an expression."""
    at = 0

    def fail(what: str):
        raise ValueError(f"{what} at {at} of {pattern!r}")

    def one() -> int:
        """A byte, written plainly or with a backslash."""
        nonlocal at
        c = pattern[at]
        at += 1
        if c == "\\":
            if at == len(pattern):
                fail("nothing behind a backslash")
            c = pattern[at]
            at += 1
            if c == "x":
                at += 2
                return int(pattern[at - 2 : at], 16)
            if c in _SPECIAL:
                return _SPECIAL[c]
            if c.isalnum():
                fail("unknown class")
        if ord(c) > 127:
            fail("not ASCII")
        return ord(c)

    def either(chars: set) -> frozenset:
        return frozenset(chars | {ord(v) for c in chars if c < 128 for v in (chr(c).lower(), chr(c).upper())}) if fold else frozenset(chars)

    def bracket() -> tuple:
        nonlocal at
        chars, out = set(), pattern[at : at + 1] == "^"
        at += out
        while pattern[at : at + 1] != "]" or not chars:
            if at >= len(pattern):
                fail("open class")
            low = one()
            if pattern[at : at + 1] == "-" and pattern[at + 1 : at + 2] not in ("]", ""):
                at += 1
                chars |= set(range(low, one() + 1))
            else:
                chars.add(low)
        at += 1
        chars = either(chars)
        return "set", frozenset(range(256)) - chars if out else chars

    def atom() -> tuple:
        nonlocal at
        c = pattern[at]
        if c in "*+?{)|":
            fail("unexpected sign")
        if c == "(":
            at += 1
            got = choice()
            if pattern[at : at + 1] != ")":
                fail("open group")
            at += 1
            return got
        if c == "[":
            at += 1
            return bracket()
        if c == ".":
            at += 1
            return "set", _ANY
        return "set", either({one()})

    def repeated() -> tuple:
        nonlocal at
        got = atom()
        while at < len(pattern) and pattern[at] in "*+?{":
            c = pattern[at]
            at += 1
            if c == "{":
                end = pattern.index("}", at)
                low, comma, high = pattern[at:end].partition(",")
                at = end + 1
                bounds = int(low), (int(high) if high else None) if comma else int(low)
            else:
                bounds = {"*": (0, None), "+": (1, None), "?": (0, 1)}[c]
            got = ("rep", got, *bounds)
        return got

    def choice() -> tuple:
        nonlocal at
        parts, row = [], []
        while at < len(pattern) and pattern[at] != ")":
            if pattern[at] == "|":
                at += 1
                parts.append(("cat", tuple(row)))
                row = []
            else:
                row.append(repeated())
        return ("or", (*parts, ("cat", tuple(row)))) if parts else ("cat", tuple(row))

    tree = choice()
    if at < len(pattern):
        fail("unexpected sign")
    return tree


def backwards(tree: tuple) -> tuple:
    kind, *rest = tree
    if kind == "set":
        return tree
    if kind == "rep":
        return ("rep", backwards(rest[0]), *rest[1:])
    parts = tuple(map(backwards, rest[0]))
    return kind, parts[::-1] if kind == "cat" else parts


class Graph:
    """A nondeterministic automaton: of each state, the states reached without a byte, and (bytes, state)."""

    def __init__(self):
        self.free: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.free.append([])
        self.moves.append([])
        return len(self.free) - 1

    def add(self, tree: tuple, begin: int) -> int:
        """Adds a tree behind a state; returns the state behind it."""
        kind, *rest = tree
        if kind == "set":
            end = self.state()
            self.moves[begin].append((rest[0], end))
            return end
        if kind == "cat":
            for part in rest[0]:
                begin = self.add(part, begin)
            return begin
        end = self.state()
        if kind == "or":
            for part in rest[0]:
                way = self.state()
                self.free[begin].append(way)
                self.free[self.add(part, way)].append(end)
            return end
        part, least, most = rest
        for _ in range(least):
            begin = self.add(part, begin)
        if most is None:
            loop = self.state()
            self.free[begin].append(loop)
            self.free[self.add(part, loop)].append(loop)
            self.free[loop].append(end)
            return end
        self.free[begin].append(end)
        for _ in range(most - least):
            begin = self.add(part, begin)
            self.free[begin].append(end)
        return end

    def closure(self, states: set) -> set:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen


class Automaton:
    """classes: the class of each byte; to: state by class; accepts: bits of each state; state 0 begins.

    sticky: a match may begin at every byte, not only at the first.
    """

    def __init__(self, trees: list[tuple], sticky: bool):
        graph = Graph()
        root = graph.state()
        ends = []
        for tree in trees:
            way = graph.state()
            graph.free[root].append(way)
            ends.append(graph.add(tree, way))
        # Bytes that all sets treat alike are one class.
        sets = sorted({tuple(sorted(s)) for moves in graph.moves for s, _ in moves})
        member = np.zeros((256, len(sets)), bool)
        for k, s in enumerate(sets):
            member[list(s), k] = True
        _, lead, self.classes = np.unique(member, axis=0, return_index=True, return_inverse=True)
        self.classes = self.classes.reshape(-1).astype(np.uint8)
        # Sets of states are bits of a number; of each class, which states it moves, and to what.
        bits = [sum(1 << t for t in graph.closure({s})) for s in range(len(graph.free))]
        ways = []
        for byte in lead.tolist():
            way = {}
            for s, moves in enumerate(graph.moves):
                for chars, t in moves:
                    if byte in chars:
                        way[s] = way.get(s, 0) | bits[t]
            ways.append((sum(1 << s for s in way), way))
        number, queue, rows = {bits[root]: 0}, [bits[root]], []
        for states in queue:
            row = []
            for movers, way in ways:
                new, left = bits[root] if sticky else 0, states & movers
                while left:
                    s = left.bit_length() - 1
                    new |= way[s]
                    left ^= 1 << s
                if new not in number:
                    number[new] = len(queue)
                    queue.append(new)
                row.append(number[new])
            rows.append(row)
        accepts = np.array([sum(1 << k for k, e in enumerate(ends) if states >> e & 1) for states in queue], np.int64)
        self.to, self.accepts, self.dead = self._least(np.array(rows), accepts)
        self.table = self.classes.tobytes()
        # A row is the list of the rows that follow, by class, and its bits at the end.
        self.rows: list[list] = [[] for _ in self.accepts]
        for s, row in enumerate(self.rows):
            row += [self.rows[t] for t in self.to[s].tolist()]
            row.append(int(self.accepts[s]))

    @staticmethod
    def _least(to: np.ndarray, accepts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Merges states that no text tells apart: parts by bits, split by where their bytes lead until none splits."""
        part = np.unique(accepts, return_inverse=True)[1].reshape(-1)
        while True:
            new = np.unique(np.column_stack([part, part[to]]), axis=0, return_inverse=True)[1].reshape(-1)
            if new.max() == part.max():
                break
            part = new
        # Numbers in order of the first state of each part, so that state 0 begins.
        _, first, back = np.unique(new, return_index=True, return_inverse=True)
        order = np.argsort(first)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        part = rank[back.reshape(-1)]
        first = first[order]
        to, accepts = part[to[first]], accepts[first]
        stuck = np.flatnonzero((to == np.arange(len(to))[:, None]).all(1) & (accepts == 0))
        return to, accepts, int(stuck[0]) if len(stuck) else -1

    def longest(self, coded: bytes, at: int) -> int:
        """End of the longest match that begins at a place, or -1."""
        row, end, dead = self.rows[0], at if self.accepts[0] else -1, self.rows[self.dead] if self.dead >= 0 else None
        for k in range(at, len(coded)):
            row = row[coded[k]]
            if row is dead:
                break
            if row[-1]:
                end = k + 1
        return end


class Scanner:
    """All rules in one automaton, and each in its own."""

    def __init__(self, rules: tuple[Rule, ...]):
        if len(rules) > 62:
            raise ValueError("a state has bits for 62 rules at most")
        self.rules = rules
        trees = [(parse(r.lead, r.fold), parse(r.body, r.fold)) for r in rules]
        self.all = Automaton([backwards(("cat", t)) for t in trees], True)
        self.own = [Automaton([("cat", t)], False) for t in trees]
        self.leads = [Automaton([lead], False) if r.least and r.lead else None for r, (lead, _) in zip(rules, trees)]

    def starts(self, data: bytes) -> list[list[int]]:
        """Stretches [from, to, rules] of bytes at each of which just these rules have a match that begins, from left to right."""
        row, out = self.all.rows[0], []
        left = iter(data.translate(self.all.table)[::-1])
        for c in left:
            row = row[c]
            if row[-1]:
                at, bits = left.__length_hint__(), row[-1]  # bytes before this one
                if out and out[-1][0] == at + 1 and out[-1][2] == bits:
                    out[-1][0] = at
                else:
                    out.append([at, at + 1, bits])
        return out[::-1]

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(from, rule, to) of all matches, by start and rule, in code points."""
        found, starts = [], self.starts(data)
        if not starts:
            return found
        for k, rule in enumerate(self.rules):
            mine = [s for s in starts if s[2] >> k & 1]
            if not mine:
                continue
            coded, lead = data.translate(self.own[k].table), None
            if self.leads[k]:
                lead = data.translate(self.leads[k].table)
            past = 0
            for low, high, _ in mine:
                at = max(low, past)
                while at < high:
                    past = self.own[k].longest(coded, at)
                    body = past - (self.leads[k].longest(lead, at) if lead is not None else at)
                    if past > at and body >= rule.least:
                        found.append((at, k, past))
                    at = past = max(past, at + 1)
        found.sort()
        edges = np.unique([x for a, _, b in found for x in (a, b)]).astype(np.int64)
        lead = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
        points = np.cumsum([np.count_nonzero(lead[a:b]) for a, b in zip([0, *edges.tolist()], edges.tolist())])
        place = dict(zip(edges.tolist(), points.tolist()))
        return [(place[a], k, place[b]) for a, k, b in found]


@functools.lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def scan(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, keep_columns: list[str] | None = None) -> DataFrame:
    """The columns asked for (default: all), then spans: an array of (kind, start, end) by start and order of rules."""
    stays = [c for c in (docs.columns if keep_columns is None else keep_columns) if c.lower() != "spans"]
    # The row travels as one struct, so that no column of it can clash with what is added.
    row = F.struct(*(docs[f"`{c}`"] for c in stays)) if stays else F.struct(F.lit(None).alias("__none"))
    source = docs.select(row.alias("__row"), docs[f"`{text}`"].cast("string").alias("__text"))
    schema = T.StructType([source.schema["__row"], T.StructField("spans", _SPANS)])
    kinds = np.array([r.kind for r in rules], object)

    def run(batches):
        every = scanner(rules)
        for batch in batches:
            for part in kit.slices(batch, "__text"):
                found = [every.spans(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in part.column("__text").cast(pa.large_string())]
                flat = np.array([s for x in found for s in x], np.int64).reshape(-1, 3)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                rows = pa.StructArray.from_arrays([pa.array(kinds[flat[:, 1]], pa.string()), pa.array(flat[:, 0]), pa.array(flat[:, 2])], fields=list(SPAN))
                yield pa.RecordBatch.from_arrays([part.column("__row"), pa.ListArray.from_arrays(pa.array(ends), rows)], names=["__row", "spans"])

    done = source.mapInArrow(kit.trimmed(run), schema)
    return done.select(*(F.col("__row")[c].alias(c) for c in stays), "spans")


def written(spans: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every stretch that spans cover replaced by a mark; spans come by start."""
    zero = F.lit(0).cast("long")
    begun = F.struct(F.lit("").alias("out"), zero.alias("past"))

    def step(done: Column, s: Column) -> Column:
        apart = s["start"] >= done["past"]
        between = F.substr(text, (done["past"] + 1).cast("int"), (s["start"] - done["past"]).cast("int"))
        return F.struct(F.when(apart, F.concat(done["out"], between, F.lit(mark))).otherwise(done["out"]).alias("out"), F.greatest(done["past"], s["end"]).alias("past"))

    return F.aggregate(spans, begun, step, lambda done: F.concat(done["out"], F.substr(text, (done["past"] + 1).cast("int"))))
