"""Channel keys of a normalised record, as arrays of strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import deleet_tokens, tokens

# Tokens that take part in pair and cross keys.
NAME_PAIR, ADDR_PAIR, CROSS_NAME, CROSS_ADDR = 8, 10, 6, 10


def _words_only(array: Column) -> Column:
    return F.filter(array, lambda t: ~t.rlike(r"^\d+$") & (t != "&"))


def char_grams(text: Column, low: int = 3, high: int = 4) -> Column:
    """n-grams of each token between two spaces; a padded token no longer than n counts once, for the smallest such n."""

    def pieces(padded: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.substring(padded, i, F.lit(n)))

    def of(token: Column) -> Column:
        padded = F.concat(F.lit(" "), token, F.lit(" "))
        none = F.array().cast("array<string>")
        sets = [F.when(F.length(padded) >= low, pieces(padded, low)).otherwise(F.array(padded))]
        sets += [F.when(F.length(padded) >= n, pieces(padded, n)).otherwise(none) for n in range(low + 1, high + 1)]
        return F.flatten(F.array(*sets))

    return F.flatten(F.transform(tokens(text), of))


def name_tokens(norm: Column, folded: Column) -> Column:
    """Words of the name and, marked by ``~``, those of its fold that the name has not."""
    own, also = _words_only(deleet_tokens(norm)), _words_only(deleet_tokens(folded))
    fresh = F.filter(also, lambda t: ~F.array_contains(own, t))
    return F.concat(own, F.transform(fresh, lambda t: F.concat(F.lit("~"), t)))


def num_key(addr: Column, house: Column) -> Column:
    """``house_token`` of the first digit-free token after the house number; '' where there is none."""
    words = tokens(addr)
    at = F.array_position(words, house)
    after = F.when(at > 0, F.slice(words, at.cast("int") + 1, F.size(words))).otherwise(words)
    first = F.get(F.filter(after, lambda t: ~t.rlike(r"\d")), F.lit(0))
    return F.when((house != "") & first.isNotNull(), F.concat_ws("_", house, first)).otherwise("")


def _capped(array: Column, most: int) -> Column:
    return F.slice(F.array_sort(F.array_distinct(array)), 1, most)


def pair_keys(text: Column, most: int) -> Column:
    """``a|b`` for all pairs a < b of the first distinct tokens in order."""
    few = _capped(F.slice(deleet_tokens(text), 1, 2 * most), most)
    return F.flatten(F.transform(few, lambda a: F.transform(F.filter(few, lambda b: b > a), lambda b: F.concat_ws("|", a, b))))


def cross_keys(name: Column, addr: Column) -> Column:
    """``n^a`` of name words and address tokens; none without an address."""
    left, right = _capped(_words_only(deleet_tokens(name)), CROSS_NAME), _capped(deleet_tokens(addr), CROSS_ADDR)
    return F.flatten(F.transform(left, lambda n: F.transform(right, lambda a: F.concat_ws("^", n, a))))
