"""Agreement of the numbers of two records, on built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import tokens

# Relation codes.
BOTH_MISSING, ONE_MISSING, EQUAL, BASE_EQUAL, PREFIX_EQUAL, CONFLICT = range(6)
NUMBER_FEATURES = [
    "house_no_rel", "postcode_rel", "unit_rel", "name_number_rel", "any_number_conflict", "house_in_other",
    "n_shared_numbers", "jaccard_numbers", "n_numbers_1", "n_numbers_2",
]


def base(token: Column) -> Column:
    """Digits of a number with an optional letter suffix, without leading zeros; null for other tokens."""
    digits = F.regexp_replace(F.regexp_extract(token, r"^(\d+)[a-z]*$", 1), "^0+(?=.)", "")
    return F.when(digits != "", digits)


def bases(array: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(array, base), lambda b: b.isNotNull()))


def _missing(a: Column, b: Column, present: Column) -> Column:
    return F.when(a & b, BOTH_MISSING).when(a | b, ONE_MISSING).otherwise(present)


def set_relation(a: Column, b: Column) -> Column:
    return _missing(F.size(a) == 0, F.size(b) == 0, F.when(F.arrays_overlap(a, b), EQUAL).otherwise(CONFLICT))


def house_relation(a: Column, b: Column) -> Column:
    same_base = F.coalesce(base(a) == base(b), F.lit(False))
    return _missing(a == "", b == "", F.when(a == b, EQUAL).when(same_base, BASE_EQUAL).otherwise(CONFLICT))


def postcode_relation(a: Column, b: Column) -> Column:
    heads = lambda x: F.transform(F.filter(x, lambda t: F.length(t) >= 4), lambda t: F.substring(t, 1, 3))
    return _missing(F.size(a) == 0, F.size(b) == 0, F.when(F.arrays_overlap(a, b), EQUAL).when(F.arrays_overlap(heads(a), heads(b)), PREFIX_EQUAL).otherwise(CONFLICT))


def number_features(left: str = "s_", right: str = "p_") -> dict[str, Column]:
    """The ten number features of a pair whose record columns carry the prefixes."""
    side = {}
    for p in (left, right):
        house, codes = F.col(p + "house_number"), tokens(F.col(p + "postcodes"))
        addr, own = tokens(F.col(p + "addr_numbers")), bases(tokens(F.col(p + "name_numbers")))
        units = bases(_units(addr, house, codes))
        side[p] = (house, codes, own, units, F.array_union(bases(addr), own))
    (h1, c1, n1, u1, all1), (h2, c2, n2, u2, all2) = side[left], side[right]
    house, post, name = house_relation(h1, h2), postcode_relation(c1, c2), set_relation(n1, n2)
    inside = lambda h, other: F.coalesce(F.array_contains(other, base(h)), F.lit(False))
    other = inside(h1, all2) | inside(h2, all1)
    shared, union = F.size(F.array_intersect(all1, all2)), F.size(F.array_union(all1, all2))
    conflict = ((house == CONFLICT) & ~other) | (post == CONFLICT) | (name == CONFLICT)
    values = [house, post, set_relation(u1, u2), name, conflict.cast("int"), other.cast("int"), shared, F.when(union > 0, shared / union), F.size(all1), F.size(all2)]
    return {f: v.cast("double").alias(f) for f, v in zip(NUMBER_FEATURES, values, strict=True)}


def _units(addr: Column, house: Column, codes: Column) -> Column:
    return F.filter(addr, lambda t: (t != house) & ~F.array_contains(codes, t))
