"""Guarded word-by-word rewriting with a predictor that the caller supplies."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Callable
from difflib import SequenceMatcher

from cloakframe import resources as R
from cloakframe.spans import measure as M

STOP = frozenset("a an and are as at be but by for from had has have he her his i in is it its me my not of on or our she so that the their them they this to was we were what when who will with you your".split())
PROTECTED = frozenset(w for terms in (*R.TARGETS.values(), *R.CUES.values()) for t in terms for w in t.split())
_WORD = re.compile(r"\[[^\]]*\]|[^\W_]+(?:'[^\W_]+)?")


def tokens(text: str) -> list[tuple[int, int, str]]:
    return [(*m.span(), m[0]) for m in _WORD.finditer(text)]


def protected(token: str) -> bool:
    low = token.lower()
    return token[0] == "[" or low in STOP or low in PROTECTED or len(low) < 3 or low.isdigit()


def seed_of(text: str, index: int, seed: int = 0) -> int:
    return int.from_bytes(hashlib.sha256(f"{seed}:{index}:{text}".encode()).digest()[:4], "big")


def eligible(text: str, k: int, seed: int = 0) -> list[int]:
    """Indexes of the k tokens most telling of style (long, odd letters or capitals), ties in a seeded order, in text order."""
    found = tokens(text)
    score = lambda w: len(w) / 4 + 2 * bool(re.search(r"(.)\1\1", w)) + (w[1:] != w[1:].lower()) + (not w.isascii())
    order = sorted((i for i, (_, _, w) in enumerate(found) if not protected(w)), key=lambda i: (-score(found[i][2]), random.Random(seed_of(text, i, seed)).random(), i))
    return sorted(order[:k])


def sanitized(token: str, word: str) -> str | None:
    """The replacement in the case of the token, or None if it must not be used."""
    w = word.strip().strip(".,;:!?\"'")
    if not re.fullmatch(r"[^\W\d_]{2,}", w) or w.lower() in PROTECTED or w.lower() == token.lower():
        return None
    variants = {token.lower(), re.sub(r"(.)\1{2,}", r"\1", token.lower()), re.sub(r"(.)\1{2,}", r"\1\1", token.lower())}
    near = max(SequenceMatcher(None, v, w.lower()).ratio() for v in variants)
    if min(len(w), len(token)) / max(len(w), len(token)) < 0.4 or near < 0.3 and w[0].lower() != token[0].lower():
        return None
    return w.upper() if token.isupper() and len(token) > 1 else w.capitalize() if token[0].isupper() else w.lower()


def sample(scores: dict[str, float], epsilon: float, rng: random.Random, low: float = -10.0, high: float = 10.0, top: int = 20) -> str | None:
    """One word, drawn from clipped scores at temperature 2 (high - low) / epsilon among the best."""
    best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:top]
    if not best:
        return None
    heat = 2 * (high - low) / epsilon
    weights = [math.exp((min(high, max(low, s)) - high) / heat) for _, s in best]
    return rng.choices([w for w, _ in best], weights)[0]


def rewrite(text: str, predict: Callable[[str, int, int], dict[str, float]], epsilon: float = 50.0, k: int = 4, seed: int = 0) -> tuple[str, dict]:
    """Text with up to k words drawn anew, and an audit. Rejected as a whole if cues are lost or the text drifts too far."""
    found, out, last, changed = tokens(text), [], 0, 0
    for i in eligible(text, k, seed):
        a, b, w = found[i]
        word = sample(predict(text, a, b), epsilon, random.Random(seed_of(text, i, seed + 1)))
        new = word and sanitized(w, word)
        if new:
            out += [text[last:a], new]
            last, changed = b, changed + 1
    new = "".join([*out, text[last:]])
    if M.cue_count(new) < M.cue_count(text):
        return text, {"changed": 0, "rejected": "cue_loss"}
    if M.ratio(text, new) < 0.6:
        return text, {"changed": 0, "rejected": "drift"}
    return new, {"changed": changed, "rejected": None}
