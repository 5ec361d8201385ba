"""String scores, token relations and alignment on worked literals."""

import itertools
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from linkengine.functions import strings as S


@pytest.mark.parametrize(
    "a, b, relation",
    [
        ("corp", "corporation", "prefix_abbrev"), ("pvt", "private", "skeleton_abbrev"), ("ltd", "limited", "skeleton_abbrev"), ("blvd", "boulevard", "skeleton_abbrev"),
        ("bd", "boulevard", "short_abbrev"), ("st", "south", "short_abbrev"), ("12", "12bis", "numeric_equal"), ("03", "3", "numeric_equal"), ("12", "13", "none"),
        ("12", "21", "none"), ("ab", "ac", "none"), ("hendersonville", "hendresonville", "typo"), ("trust", "trsut", "typo"), ("kolkata", "k01kata", "fold_exact"), ("x", "x", "exact"),
    ],
)
def test_relation(a, b, relation):
    assert S.token_relation(a, b) == S.token_relation(b, a) == relation


def test_alignment():
    al = S.Alignment(["sbi"], "state bank of india".split())
    assert al.rel == (["initialism"], ["initialism"] * 4)
    al = S.Alignment("walmart store".split(), "wal mart store".split())
    assert sorted(x.relation for x in al.links) == ["exact", "split_join"]
    assert S.Alignment([], ["a"]).rel == ([], [None])


def test_field_features():
    left, right = "acme tools pvt ltd".split(), "acme tolls private limited zorbex".split()
    f = dict(zip(S.FIELD_FEATURES, S.field_features(left, right, ([1.0] * 4, [1.0] * 4 + [9.0]), ([False] * 4, [False] * 5)), strict=True))
    assert (f["n_exact"], f["n_typo"], f["n_abbrev"], f["unexpl_max_idf_2"], f["core_equal"]) == (1, 1, 2, 9.0, 0.0)
    f = dict(zip(S.FIELD_FEATURES, S.field_features(left, right, ([1.0] * 4, [1.0] * 4 + [9.0]), ([False] * 4, [False] * 4 + [True])), strict=True))
    assert (f["core_equal"], f["n_dropped_generic"]) == (1.0, 1)


def test_scores():
    assert S.damerau("ca", "abc") == 2
    assert S.jaro_winkler("abcd", "abxy") == pytest.approx(2 / 3)
    assert S.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert S.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100
    assert S.token_sort_ratio("new york mets", "mets new york") == 100
    assert S.partial_ratio("york", "new york mets") == 100
    assert S.lev_ratio("kitten", "sitting") == pytest.approx(100 * (1 - 3 / 7))


@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_lcs_by_enumeration(a, b):
    best = max(len(c) for n in range(len(a) + 1) for c in itertools.combinations(a, n) if _inside(c, b))
    assert S.lcs(a, b) == best


def _inside(c, b):
    it = iter(b)
    return all(x in it for x in c)


def test_symmetric_scores():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("ab c") for _ in range(rng.randint(1, 9))) for _ in range(2))
        for f in (S.ratio, S.damerau, S.levenshtein, S.jaro):
            assert f(a, b) == pytest.approx(f(b, a))
