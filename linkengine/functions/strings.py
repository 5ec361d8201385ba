"""String similarities (0-100), by their published definitions, and the typed relation of two tokens."""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import FOLDS

# --- distances -----------------------------------------------------------------------------------------------------------


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    if len(a) > len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 200.0 * lcs(a, b) / total if total else 100.0


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text against a window of the longer one, cut at its ends too.

    A window's letters bound its ratio, so windows are tried from the best bound down until no bound can win.
    """
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n, need, have, common = len(a), Counter(a), Counter(), 0
    bounds = []
    for end in range(1, len(b) + n):
        if end <= len(b):
            ch = b[end - 1]
            common += have[ch] < need[ch]
            have[ch] += 1
        if end > n:
            ch = b[end - n - 1]
            have[ch] -= 1
            common -= have[ch] < need[ch]
        lo, hi = max(0, end - n), min(end, len(b))
        if common:
            bounds.append((200.0 * common / (n + hi - lo), lo, hi))
    best = 0.0
    for bound, lo, hi in sorted(bounds, reverse=True):
        if bound <= best:
            break
        best = max(best, ratio(a, b[lo:hi]))
    return best


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """Best of: common tokens against each side, and the sides against each other; 100 where one side is contained."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    only_x, only_y = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_x or not only_y):
        return 100.0
    left, right = f"{both} {only_x}".strip(), f"{both} {only_y}".strip()
    best = ratio(left, right)
    if both:
        best = max(best, ratio(both, left), ratio(both, right))
    return best


def partial_token_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if x & y:
        return 100.0
    sides = [partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))]
    if x - y and y - x:
        sides.append(partial_ratio(" ".join(sorted(x - y)), " ".join(sorted(y - x))))
    return max(sides)


def weighted_ratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    plain, longer = ratio(a, b), max(len(a), len(b)) / min(len(a), len(b))
    if longer < 1.5:
        return max(plain, 0.95 * token_sort_ratio(a, b), 0.95 * token_set_ratio(a, b))
    scale = 0.9 if longer <= 8.0 else 0.6
    return max(plain, scale * partial_ratio(a, b), 0.95 * scale * partial_token_ratio(a, b))


def levenshtein(a: str, b: str) -> int:
    """Edits by bit-parallel columns: a bit for each letter of the longer text where the distance rises or falls."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full, last, edits = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    rise, fall = full, 0
    for ch in b:
        hit = masks.get(ch, 0) | fall
        same = ((((hit & rise) + rise) ^ rise) | hit) & full
        more, less = fall | (full & ~(same | rise)), rise & same
        edits += bool(more & last) - bool(less & last)
        more, less = (more << 1 | 1) & full, less << 1 & full
        rise, fall = less | (full & ~(same | more)), more & same
    return edits


def lev_ratio(a: str, b: str) -> float:
    longest = max(len(a), len(b))
    return 100.0 * (1 - levenshtein(a, b) / longest) if longest else 100.0


def damerau(a: str, b: str) -> int:
    """Edits with transpositions of letters that may since have been parted (the unrestricted distance)."""
    far = len(a) + len(b)
    seen: dict[str, int] = {}
    d = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i, x in enumerate(a, 1):
        same = 0
        for j, y in enumerate(b, 1):
            up, left = seen.get(y, 0), same
            cost = 1
            if x == y:
                cost, same = 0, j
            d[i + 1][j + 1] = min(d[i][j] + cost, d[i + 1][j] + 1, d[i][j + 1] + 1, d[up][left] + (i - up - 1) + 1 + (j - left - 1))
        seen[x] = i
    return d[-1][-1]


def within(a: str, b: str, most: int) -> bool:
    """Whether :func:`damerau` is at most ``most``: it is the plain distance at most, and half of it at least."""
    edits = levenshtein(a, b)
    return edits <= most or (edits <= 2 * most and damerau(a, b) <= most)


#: Marks a matched letter; no text holds this noncharacter.
TAKEN = "\U0010ffff"


def jaro(a: str, b: str) -> float:
    if not a or not b:
        return float(a == b)
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    rest, left = b, []
    for i, x in enumerate(a):
        j = rest.find(x, max(0, i - reach), i + reach + 1)
        if j >= 0:
            rest = rest[:j] + TAKEN + rest[j + 1 :]
            left.append(x)
    m = len(left)
    if not m:
        return 0.0
    right = [y for y, r in zip(b, rest, strict=True) if r == TAKEN]
    swaps = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """The bonus for a common start of up to four letters applies above a Jaro similarity of 0.7."""
    s = jaro(a, b)
    if s <= 0.7:
        return s
    start = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return s + 0.1 * start * (1 - s)


def jw_ratio(a: str, b: str) -> float:
    return 100.0 * jaro_winkler(a, b)


SCORERS: dict[str, Callable[[str, str], float]] = {
    "ratio": ratio, "partial_ratio": partial_ratio, "token_sort_ratio": token_sort_ratio, "token_set_ratio": token_set_ratio,
    "WRatio": weighted_ratio, "jw": jw_ratio, "lev": lev_ratio,
}


def _paired(f: Callable[[str, str], object], kind: T.DataType):
    """An Arrow function of two text columns that works out each distinct pair of a batch once."""

    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        held = {(x, y): None if x is None or y is None else f(x, y) for x, y in set(zip(a, b, strict=True))}
        return pd.Series([held[key] for key in zip(a, b, strict=True)])

    return run


def all_scores(a: str | None, b: str | None, names: list[str]) -> list[float | None]:
    """The similarities of one pair; unknown where a side is empty."""
    if not a or not b:
        return [None] * len(names)
    return [100.0 if a == b else SCORERS[n](a, b) for n in names]


def score(name: str, a: Column, b: Column) -> Column:
    """A similarity of two text columns; null where a side is empty.  Levenshtein is built in, the others are Arrow functions."""
    if name == "lev":
        value = (1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))) * 100
    else:
        value = _paired(SCORERS[name], T.DoubleType())(a, b)
    return F.when((F.length(a) > 0) & (F.length(b) > 0), value)


def damerau_distance(a: Column, b: Column) -> Column:
    return _paired(damerau, T.IntegerType())(a, b)


# --- tokens --------------------------------------------------------------------------------------------------------------

# How strong a relation counts when links compete.
STRENGTH = {
    "exact": 1.0, "fold_exact": 0.95, "numeric_equal": 0.95, "split_join": 0.9, "typo": 0.85, "prefix_abbrev": 0.8,
    "initialism": 0.8, "skeleton_abbrev": 0.7, "short_abbrev": 0.45, "none": 0.0,
}
_LOOKALIKE = str.maketrans("0134578", "oleastb")
_FOLD = [(re.compile(p), into.replace("$1", r"\1")) for p, into in FOLDS]


def has_digit(token: str) -> bool:
    return not token.isalpha() and any(c.isdigit() for c in token)


@lru_cache(200_000)
def plain(token: str) -> str:
    """The token with its look-alike digits as letters."""
    digits = sum(c.isdigit() for c in token)
    if not digits or 2 * digits >= len(token) or re.fullmatch(r"\d+[a-z]{0,4}", token):
        return token
    return token.translate(_LOOKALIKE)


@lru_cache(200_000)
def folded(token: str) -> str:
    return folds([token])[0]


def folds(words: list[str]) -> list[str]:
    """The words without look-alike digits, those without a digit as they sound; one pass over all of them, as no rule goes beyond a line."""
    out = [w if w.isalpha() else plain(w) for w in words]
    at = [k for k, w in enumerate(out) if w.isalpha() or not has_digit(w)]
    text = "\n".join(out[k] for k in at)
    for pattern, into in _FOLD:
        text = text.replace(pattern.pattern, into) if pattern.pattern.isalpha() else pattern.sub(into, text)
    for k, w in zip(at, text.split("\n") if at else [], strict=True):
        out[k] = w
    return out


def number_base(token: str) -> str | None:
    m = re.fullmatch(r"(\d+)[a-z]*", token)
    return (m[1].lstrip("0") or "0") if m else None


class TokenPair:
    """Two tokens seen by the rules: ``words`` without look-alike digits, the shorter first, and ``sounds``, their folds."""

    def __init__(self, a: str, b: str):
        self.words = tuple(sorted((plain(a), plain(b)), key=lambda w: (len(w), w)))
        self.sounds = (folded(a), folded(b))

    def numeric(self) -> bool:
        return any(map(has_digit, self.words))

    def one_number(self) -> bool:
        bases = {number_base(w) for w in self.words}
        return len(bases) == 1 and None not in bases

    def slip(self) -> bool:
        """A few edits in spelling or sound, or much the same letters; not for words below three letters."""
        short, long = self.words
        allowed = 1 if len(long) <= 5 else 2
        edited = lambda x, y: abs(len(x) - len(y)) <= allowed and within(x, y, allowed)
        return len(short) >= 3 and (edited(short, long) or edited(*self.sounds) or jaro_winkler(short, long) >= 0.92)

    def start(self) -> bool:
        short, long = self.words
        return 2 <= len(short) < len(long) and long[: len(short)] == short

    def skeleton(self) -> bool:
        """The first letter and others in order, up to 0.7 of the length."""
        short, long = self.words
        return 2 <= len(short) <= 0.7 * len(long) and short[0] == long[0] and lcs(short, long) == len(short)

    def two_letters(self) -> bool:
        return len(self.words[0]) == 2 and (self.start() or self.skeleton())


#: The first rule that holds names the relation; tokens with a digit are never typos or abbreviations of each other.
NUMBER_RULES: list[tuple[str, Callable[[TokenPair], bool]]] = [
    ("numeric_equal", TokenPair.one_number),
    ("exact", lambda p: p.words[0] == p.words[1]),
]
WORD_RULES: list[tuple[str, Callable[[TokenPair], bool]]] = [
    ("fold_exact", lambda p: p.words[0] == p.words[1] or p.sounds[0] == p.sounds[1]),
    ("typo", TokenPair.slip),
    ("short_abbrev", TokenPair.two_letters),
    ("prefix_abbrev", TokenPair.start),
    ("skeleton_abbrev", TokenPair.skeleton),
]


@lru_cache(200_000)
def _by_rules(pair: frozenset) -> str:
    seen = TokenPair(*sorted(pair))
    return next((name for name, holds in (NUMBER_RULES if seen.numeric() else WORD_RULES) if holds(seen)), "none")


def token_relation(a: str, b: str) -> str:
    """The strongest relation of two tokens, the same in both directions."""
    return "exact" if a == b else _by_rules(frozenset((a, b)))


relation = _paired(token_relation, T.StringType())

# --- alignment -----------------------------------------------------------------------------------------------------------

# Tokens of a joined word, tokens that initials may span, letters of a token that initials may skip.
JOIN_SPAN, ACRONYM_SPAN, SKIPPED = 3, 6, 3
_SHORT, _LONG = "\x01", "\x02"


@dataclass(frozen=True, order=True)
class Proposal:
    """A possible link: proposals are taken by ``turn``, then ``rank``, while all their tokens are free."""

    turn: int
    rank: tuple
    left: tuple[int, ...]
    right: tuple[int, ...]
    relation: str


def _numbered(tokens: list[str]) -> dict[tuple[str, int], int]:
    """Place of the n-th occurrence of each token."""
    seen: Counter = Counter()
    out = {}
    for place, t in enumerate(tokens):
        out[t, seen[t]] = place
        seen[t] += 1
    return out


def _equal(left: list[str], right: list[str]) -> Iterator[Proposal]:
    """The n-th occurrence of a token meets the n-th on the other side."""
    there = _numbered(right)
    for key, i in _numbered(left).items():
        if key in there:
            yield Proposal(0, (i,), (i,), (there[key],), "exact")


def _joins(tokens: list[str]) -> dict[str, list[tuple[int, ...]]]:
    """Runs of two and three tokens by the fold of their joined text."""
    out: dict[str, list[tuple[int, ...]]] = {}
    runs = [(start, n) for start in range(len(tokens)) for n in range(2, min(JOIN_SPAN, len(tokens) - start) + 1)]
    for (start, n), fold in zip(runs, folds(["".join(tokens[a : a + n]) for a, n in runs]), strict=True):
        out.setdefault(fold, []).append(tuple(range(start, start + n)))
    return out


@lru_cache(50_000)
def _speller(word: str) -> re.Pattern:
    """Runs of token shapes (initial, short or long) that spell ``word``, at every start; short tokens with another initial are skipped."""
    any_shape = f"[{_SHORT}{_LONG}]"
    rest = "".join(f"(?:[^{re.escape(c)}]{_SHORT})*{re.escape(c)}{any_shape}" for c in word[1:])
    return re.compile(f"(?=({re.escape(word[0])}{any_shape}{rest}))", re.DOTALL)


def _shapes(tokens: list[str]) -> str:
    return "".join(t[0] + (_SHORT if len(t) <= SKIPPED else _LONG) for t in tokens)


def _spelt(word: str, shapes: str) -> Iterator[tuple[int, int]]:
    """(start, length) of the runs of tokens of which ``word`` may be the initials."""
    runs = ((m.start() // 2, len(m[1]) // 2) for m in _speller(word).finditer(shapes) if m.start() % 2 == 0)
    return ((a, n) for a, n in runs if n <= ACRONYM_SPAN)


def _spans(turn: int, words: list[str], other: list[str], flip: bool) -> Iterator[Proposal]:
    """A word against a run of tokens of the other side: its parts first, then what it may be the initials of."""
    joins, shapes = _joins(other), _shapes(other)
    for i, word in enumerate(words):
        if has_digit(word):
            continue
        runs = []
        if len(word) >= 4:
            close = (run for run in joins.get(folded(word), ()) if abs(sum(len(other[k]) for k in run) - len(word)) <= 2)
            runs += [(0, run, "split_join") for run in close]
        if 2 <= len(word) <= 5:
            runs += [(1, tuple(range(a, a + n)), "initialism") for a, n in _spelt(word, shapes)]
        for kind, run, name in runs:
            yield Proposal(turn, (i, kind, run), run if flip else (i,), (i,) if flip else run, name)


def _singles(left: list[str], right: list[str], free: tuple[set[int], set[int]]) -> Iterator[Proposal]:
    """One token against one, by strength, then by nearness of relative place."""
    for i in sorted(free[0]):
        for j in sorted(free[1]):
            name = token_relation(left[i], right[j])
            if name != "none":
                yield Proposal(3, (-STRENGTH[name], abs(i / len(left) - j / len(right))), (i,), (j,), name)


class Alignment:
    """Links between two token lists; ``rel`` holds the relation of each token of both, or None."""

    def __init__(self, left: list[str], right: list[str]):
        self.links: list[Proposal] = []
        self.rel: tuple[list[str | None], list[str | None]] = ([None] * len(left), [None] * len(right))
        free = (set(range(len(left))), set(range(len(right))))
        turns = (lambda: _equal(left, right), lambda: _spans(1, left, right, False), lambda: _spans(2, right, left, True), lambda: _singles(left, right, free))
        for proposals in turns:
            if free[0] and free[1]:
                for p in sorted(proposals()):
                    if free[0].issuperset(p.left) and free[1].issuperset(p.right):
                        self._take(p, free)

    def _take(self, p: Proposal, free: tuple[set[int], set[int]]) -> None:
        self.links.append(p)
        for rel, places, own in zip(self.rel, (p.left, p.right), free, strict=True):
            own.difference_update(places)
            for k in places:
                rel[k] = p.relation

    def order(self) -> float | None:
        """Kendall's tau of the one-to-one links' places, from the number of inversions; None below two of them."""
        single = sorted((p.left[0], p.right[0]) for p in self.links if len(p.left) == len(p.right) == 1)
        n = len(single)
        if n < 2:
            return None
        passed: list[int] = []
        inversions = 0
        for _, j in single:
            at = bisect.bisect(passed, j)
            inversions += len(passed) - at
            passed.insert(at, j)
        return 1 - 4 * inversions / (n * (n - 1))


# Names and order of a field's figures.
FIELD_FEATURES = [
    "expl_frac_idf", "expl_frac_idf_min", "unexpl_max_idf_1", "unexpl_max_idf_2", "unexpl_sum_idf_1", "unexpl_sum_idf_2",
    "n_exact", "n_fold", "n_typo", "n_abbrev", "n_short_abbrev", "n_initialism", "n_splitjoin", "n_numeq",
    "n_dropped_generic", "n_unexpl", "n_unexpl_1", "n_unexpl_2", "order_tau", "core_equal", "first_explained", "ntok_1", "ntok_2",
]


def field_features(left: list[str], right: list[str], idf: tuple[list[float], list[float]], generic: tuple[list[bool], list[bool]]) -> list[float | None]:
    """How well the tokens of one field explain each other, in the order of FIELD_FEATURES."""
    return field_figures(Alignment(left, right), idf, generic)


def field_figures(al: Alignment, idf: tuple[list[float], list[float]], generic: tuple[list[bool], list[bool]]) -> list[float | None]:
    """The figures of :func:`field_features` of an alignment."""
    left, right = al.rel
    count = Counter(p.relation for p in al.links)
    total = [sum(w) for w in idf]
    known = [sum(w for w, r in zip(ws, rs, strict=True) if r) for ws, rs in zip(idf, al.rel, strict=True)]
    open_ = [[w for w, r, g in zip(ws, rs, gs, strict=True) if not r and not g] for ws, rs, gs in zip(idf, al.rel, generic, strict=True)]
    dropped = sum(not r and g for rs, gs in zip(al.rel, generic, strict=True) for r, g in zip(rs, gs, strict=True))
    shares = [k / t if t > 0 else 1.0 for k, t in zip(known, total, strict=True)]
    first = bool(left and right and left[0] and right[0])
    return [
        sum(known) / sum(total) if sum(total) > 0 else None, min(shares) if left and right else None,
        max(open_[0], default=0.0), max(open_[1], default=0.0), sum(open_[0]), sum(open_[1]),
        count["exact"], count["fold_exact"], count["typo"], count["prefix_abbrev"] + count["skeleton_abbrev"], count["short_abbrev"],
        count["initialism"], count["split_join"], count["numeric_equal"], dropped, len(open_[0]) + len(open_[1]), len(open_[0]), len(open_[1]),
        al.order(), float(not open_[0] and not open_[1]), float(first), len(left), len(right),
    ]
