"""Boosted trees that judge candidate spans of personal data, trained here on drawn examples.

Features are regular expressions on a candidate or on what stands before it, plus two lengths.
They mean the same to Python, which trains, and to Spark SQL, which scores, so the trees become
plain CASE expressions there.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import cache

import numpy as np

#: Code points before a candidate that context features see.
CONTEXT = 28
#: Contexts of drawn secrets.
SECRET_CONTEXTS = tuple(w + e for w in ("token", "secret", "password", "passwd", "api_key", "auth", "secret_key", "credentials") for e in (' = "', ": ", "=", " = '", " = ")) + ("Authorization: Bearer ", "Authorization: ", "bearer ")
#: Every expression takes time in proportion to the text, since candidates may be long: it begins at
#: the start, or gives nothing back.
#: name, what it looks at (value or context), expression
FEATURES: tuple[tuple[str, str, str], ...] = (
    ("digit", "value", r"[0-9]"),
    ("letter", "value", r"[A-Za-z]"),
    ("hex", "value", r"^(?:[0-9a-f]+|[0-9A-F]+)$"),
    ("mixed_case", "value", r"^(?=[^a-z]*+[a-z])[^A-Z]*+[A-Z]"),
    ("many_digits", "value", r"^(?:[^0-9]*+[0-9]){6}"),
    ("ssn_form", "value", r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"),
    ("phone_form", "value", r"^(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}$"),
    ("at_dot", "value", r"(?i)^(?>.*?\bat\b).*\bdot\b"),
    ("brackets", "value", r"[\[(](?:at|dot)[\])]"),
    ("secret_word", "context", r"(?i)(?:token|passw[a-z]*|(?:api|private|access).?key|secret(?:.?key)?|auth(?:entication|orization)?|bearer|credential)s?[^A-Za-z]{0,6}$"),
    ("phone_word", "context", r"(?i)(?:phone|tel|call|fax|mobile|cell)[a-z]{0,4}[^A-Za-z]{0,6}$"),
    ("id_word", "context", r"(?i)(?:ssn|social security|tax id|passport)[a-z ]{0,8}[^A-Za-z]{0,6}$"),
    ("mail_word", "context", r"(?i)(?:mail|contact|write|reach)[a-z ]{0,10}[^A-Za-z]{0,6}$"),
    ("quoted", "context", r"[=:]\s*[^A-Za-z0-9]?$"),
)
NUMBERS = ("length", "digits")
#: Kinds that the generators propose, in the order of their codes.
KINDS = ("secret", "phone", "ssn", "email")
N_TREES, RATE, DRAWS = 24, 0.5, 3000


def features(kind: int, value: str, context: str) -> list[float]:
    flags = [float(bool(re.search(x, value if where == "value" else context))) for _, where, x in FEATURES]
    return [float(kind), *flags, float(len(value)), float(sum(c in "0123456789" for c in value))]


def draw(r: random.Random) -> tuple[int, str, str, int]:
    """A candidate with its context, and whether it is personal data or a secret."""
    word = lambda: "".join(r.choice("aeinorst") for _ in range(r.randint(2, 8)))
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    plain = f"{word()} {word()} {word()} "
    kind = r.randrange(4)
    if kind == 0:
        good = r.random() < 0.5
        n = r.choice((24, 32, 40, 48, 64, 129, 256, 1024))
        alphabet = r.choice(("0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        value = "".join(r.choice(alphabet) for _ in range(n))
        if good:
            return 0, value, plain + r.choice(SECRET_CONTEXTS), 1
        value = r.choice((value, "".join(r.choice("aeiouthns") for _ in range(n)), digits(n), "-" * n, word() * 6))
        return 0, value, plain + r.choice(("", "commit ", "sha ", "id: ", "author: ")), 0
    if kind == 1:
        good = r.random() < 0.5
        value = r.choice((f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}"))
        if good:
            return 1, value, plain + r.choice(("phone: ", "call ", "tel. ", "fax ", "mobile ", "")), 1
        value = r.choice((digits(r.randint(8, 20)), f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}.{digits(2)} {digits(4)}", f"{digits(4)} {digits(4)} {digits(4)} {digits(4)}"))
        return 1, value, plain + r.choice(("", "on ", "no. ", "call ")), 0
    if kind == 2:
        good = r.random() < 0.5
        if good:
            return 2, f"{digits(3)}-{digits(2)}-{digits(4)}", plain + r.choice(("ssn ", "SSN: ", "social security number ", "tax id ")), 1
        return 2, r.choice((f"{digits(3)}-{digits(2)}-{digits(4)}", f"{digits(4)}-{digits(2)}-{digits(2)}")), plain + r.choice(("", "part ", "no. ")), 0
    if r.random() < 0.5:
        a, d = r.choice(((" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", " (dot) ")))
        ctx = r.choice(("mail ", "contact me: ", "write to ", "reach us ")) if a == " at " else r.choice(("", "mail "))
        return 3, f"{word()}{a}{word()}{d}{r.choice(('com', 'org', 'net', 'de'))}", plain + ctx, 1
    return 3, f"{word()} at {word()} dot {word()}", plain, 0


@dataclass(frozen=True)
class Tree:
    """Depth two: a split, then one on each side; leaves from (low, low) to (high, high)."""

    splits: tuple[tuple[int, float], tuple[int, float], tuple[int, float]]
    leaves: tuple[float, float, float, float]


@dataclass(frozen=True)
class Boosted:
    start: float
    trees: tuple[Tree, ...]
    thresholds: tuple[float, ...]  # by kind, of the calibrated probability
    slope: float
    offset: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for t in self.trees:
            (f, c), (fl, cl), (fh, ch) = t.splits
            out += np.where(x[:, f] <= c, np.where(x[:, fl] <= cl, t.leaves[0], t.leaves[1]), np.where(x[:, fh] <= ch, t.leaves[2], t.leaves[3]))
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(x) + self.offset)))


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
    best = (-1.0, 0, float("inf"))
    for f in range(x.shape[1]):
        for c in np.unique(x[:, f])[:-1]:
            low = x[:, f] <= c
            gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (low, ~low))
            if gain > best[0] + 1e-9:
                best = (gain, f, float(c))
    return best[1:]


@cache
def train(seed: int = 11) -> Boosted:
    """Newton boosting on drawn candidates; a slope, an offset and thresholds from others held out."""
    r = random.Random(seed)
    rows = [draw(r) for _ in range(DRAWS)]
    x, y = np.array([features(*d[:3]) for d in rows]), np.array([d[3] for d in rows], float)
    fit, held = slice(0, DRAWS * 2 // 3), slice(DRAWS * 2 // 3, DRAWS)
    xs, ys = x[fit], y[fit]
    start = float(np.log(ys.mean() / (1 - ys.mean())))
    out, trees = np.full(len(xs), start), []
    for _ in range(N_TREES):
        p = 1 / (1 + np.exp(-out))
        g, h = ys - p, p * (1 - p)
        f, c = _split(xs, g, h)
        low = xs[:, f] <= c
        subs, leaves = [], []
        for side in (low, ~low):
            s = _split(xs[side], g[side], h[side]) if side.any() else (0, float("inf"))
            subs.append(s)
            inner = xs[:, s[0]] <= s[1]
            leaves += [round(RATE * float(g[m].sum() / (h[m].sum() + 1)), 4) if m.any() else 0.0 for m in (side & inner, side & ~inner)]
        trees.append(Tree(((f, c), *subs), tuple(leaves)))
        out = Boosted(start, tuple(trees), (), 1, 0).raw(xs)
    model = Boosted(start, tuple(trees), (), 1.0, 0.0)
    z, t, a, b = model.raw(x[held]), y[held], 1.0, 0.0
    for _ in range(200):  # Platt's scaling by gradient steps
        e = 1 / (1 + np.exp(-(a * z + b))) - t
        a, b = a - 0.05 * float((e * z).mean()), b - 0.05 * float(e.mean())
    a, b = round(a, 4), round(b, 4)
    p, kind, thresholds = 1 / (1 + np.exp(-(a * z + b))), x[held][:, 0], []
    for k in range(len(KINDS)):
        own = kind == k
        bad = p[own & (t == 0)]
        thresholds.append(round(max(0.7, float(bad.max(initial=0)) + 0.01), 3))  # above all held-out clean ones
    return Boosted(start, tuple(trees), tuple(thresholds), a, b)
