"""Evidence and prompt texts for a language-model judge, and the attachment of its scores.  No model is part of this library."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numbers
from ..functions.strings import Alignment, score
from ..functions.text import DERIVED, normalise_records, scramble

# Wording of the evidence.
RELATIONS = {
    "fold_exact": "same sound", "numeric_equal": "same number", "split_join": "split/join", "typo": "typo", "prefix_abbrev": "abbreviation",
    "skeleton_abbrev": "abbreviation", "initialism": "initials", "short_abbrev": "short abbreviation",
}
CODES = ["both missing", "one missing", "equal", "same base", "same prefix", "conflict"]
LONGEST = 160
SHOWN = 8


@F.pandas_udf(T.StructType([T.StructField("links", T.StringType()), T.StructField("unexplained", T.StringType())]))
def field_evidence(a: pd.Series, b: pd.Series, generic: pd.Series) -> pd.DataFrame:
    """How two clean fields align, and the words that nothing explains; ``generic`` words are marked."""
    links, rest = [], []
    for x, y, g in zip(a, b, generic, strict=True):
        left, right, usual = x.split(), y.split(), set(g if g is not None else ())
        al = Alignment(left, right)
        equal = sum(x.relation == "exact" for x in al.links)
        parts = [f"{equal} exact"] * (equal > 0)
        parts += [f"'{' '.join(left[i] for i in p)}'~'{' '.join(right[j] for j in q)}' ({RELATIONS[r]})" for p, q, r in ((x.left, x.right, x.relation) for x in al.links) if r != "exact"]
        links.append("; ".join(parts[:SHOWN]) or "none")
        sides = [[t + "(generic)" * (t in usual) for t, r in zip(ts, rs, strict=True) if r is None] for ts, rs in zip((left, right), al.rel, strict=True)]
        rest.append(" | ".join(f"{n}: {' '.join(s[:SHOWN]) or '-'}" for n, s in zip("AB", sides, strict=True)))
    return pd.DataFrame({"links": links, "unexplained": rest})


def clipped(text: Column, n: int = LONGEST) -> Column:
    one = F.trim(F.regexp_replace(F.replace(text, F.lit('"'), F.lit("'")), r"\s+", " "))
    return F.when(F.length(one) <= n, one).otherwise(F.concat(F.substring(one, 1, n - 1), F.lit("…")))


def evidence(generic_name: Column, generic_addr: Column) -> Column:
    """Evidence lines of a pair with record columns s_ and p_."""
    s, p = (lambda c: F.col(f"s_{c}")), (lambda c: F.col(f"p_{c}"))
    name, addr = field_evidence(s("norm_name"), p("norm_name"), generic_name), field_evidence(s("norm_addr"), p("norm_addr"), generic_addr)
    said = lambda code: F.element_at(F.array(*map(F.lit, CODES)), code.cast("int") + 1)
    num = numbers.number_features()
    or_dash = lambda c, dash="-": F.when(c == "", dash).otherwise(c)
    close = lambda f: F.format_number(F.coalesce(score("token_set_ratio", s(f), p(f)), F.lit(0.0)) / 100, 2)
    return F.concat_ws(
        "\n", F.concat(F.lit("- Name alignment: "), name["links"]), F.concat(F.lit("- Unexplained name words: "), name["unexplained"]),
        F.concat(F.lit("- Address alignment: "), addr["links"]), F.concat(F.lit("- Unexplained address words: "), addr["unexplained"]),
        F.format_string("- Numbers: house %s vs %s: %s; postcode %s vs %s: %s; other numbers: %s", or_dash(s("house_number")), or_dash(p("house_number")), said(num["house_no_rel"]), or_dash(s("postcodes")), or_dash(p("postcodes")), said(num["postcode_rel"]), said(num["unit_rel"])),
        F.format_string("- Landmarks: A: %s | B: %s", or_dash(s("landmark"), "none"), or_dash(p("landmark"), "none")),
        F.format_string("- Similarity: name %s, address %s", close("norm_name"), close("norm_addr")),
    )


def prompts(pairs: DataFrame, generic: DataFrame, kept: list[str] | None = None) -> DataFrame:
    """s1_id, cand_id, ``kept`` columns, user text; pairs with records and raw fields (s_raw_name, ...), generic (field, token)."""
    lists = {r["field"]: r["ts"] for r in generic.groupBy("field").agg(F.collect_set("token").alias("ts")).collect()}  # legal forms and street types: a short list
    arr = lambda f: F.array(*map(F.lit, sorted({*lists.get(f, []), "&"})))
    side = lambda n, p: F.format_string(f'Record {n}: name = "%s" | address = "%s"', clipped(F.col(p + "raw_name")), clipped(F.col(p + "raw_addr")))
    user = F.concat(side("A", "s_"), F.lit("\n"), side("B", "p_"), F.lit("\n\nEvidence (automatically computed):\n"), evidence(arr("norm_name"), arr("norm_addr")), F.lit("\nSame business?"))
    return pairs.select("s1_id", "cand_id", *(kept or []), user.alias("user"))


def augmented(pairs: DataFrame, seed: int = 42, swap: float = 0.5, drop_addr: float = 0.05, scrambled: float = 0.07) -> DataFrame:
    """Pairs with records and raw fields, changed by hash; ``aug`` names what was done.

    One address of the two is dropped, then the letters of both records are permuted, then the sides are swapped; whatever
    is derived from the raw fields is normalised again.
    """

    def u(k: int) -> Column:
        return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit(k), "s1_id", "cand_id")), 1, 8), 16, 10).cast("double") / 4294967296.0

    turned, dropped, mixed, which = u(1) < swap, u(2) < drop_addr, u(3) < scrambled, u(4) < 0.5
    addr = {"s_": F.when(dropped & which, "").otherwise(F.col("s_raw_addr")), "p_": F.when(dropped & ~which, "").otherwise(F.col("p_raw_addr"))}
    other = {"s_": "p_", "p_": "s_"}
    keep = [c for c in pairs.columns if not c.startswith(("s_", "p_"))]
    done = F.concat_ws(",", F.when(dropped, "drop_addr"), F.when(mixed, "scramble"), F.when(turned, "swap")).alias("aug")
    out = pairs.select(*keep, done, F.struct(turned.alias("turned"), mixed.alias("mixed")).alias("how"), *[c for p in other for c in (F.col(p + "raw_name"), addr[p].alias(p + "raw_addr"), F.col(p + "country"), F.col(p + "source"))])
    for p in other:
        out = out.withColumns({f"{p}{c}": F.when(F.col("how.mixed"), scramble(F.col(f"{p}{c}"), seed)).otherwise(F.col(f"{p}{c}")) for c in ("raw_name", "raw_addr")})
    fields = ("raw_name", "raw_addr", "country", "source")
    out = out.withColumns({f"{p}{c}": F.when(F.col("how.turned"), F.col(other[p] + c)).otherwise(F.col(p + c)) for p in other for c in fields}).drop("how")
    for p in other:
        side = out.withColumnsRenamed({p + c: c for c in fields})
        out = normalise_records(side).withColumnsRenamed({c: p + c for c in (*fields, *DERIVED)})
    return out


def attach(pairs: DataFrame, judged: DataFrame) -> DataFrame:
    """Judge scores of the pairs that it reached; null for all others."""
    return pairs.join(judged.select("s1_id", "cand_id", "pl"), ["s1_id", "cand_id"], "left")

