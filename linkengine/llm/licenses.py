"""License scan by MinHash bands over overlapping text windows, on built-in functions only.

A text's words are ``[a-z0-9]+`` after lower-casing A-Z; windows of ``WIDTH`` words start every ``STRIDE`` words, so that each
five-word shingle lies in exactly one window and windows overlap by the rest.  A window has ``BANDS`` bands of one minwise
value each.  A template is cut into windows of as many shingles, one from each of its words on, and filed under their bands; one
of fewer shingles is one window.  It is retrieved when a band of a window of the text equals one of its own: with a
probability of 1 - (1 - J)^BANDS for two windows of similarity J.  An intact window meets its own with certainty; the only
shingle of a template, alone in a window of four (J = 1/4), is missed with 1e-6; one common shingle of two full windows
(J = 1/7) with 6e-4, and a template that a text holds for three quarters has many such windows.  Retrieved templates are
verified exactly: the text must hold at least ``PERCENT`` of the template's distinct shingles.

Only texts with a marker are cut into words.  That loses nothing: the markers cover so many shingles of each template that
the others alone stay below ``PERCENT`` (checked below).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = 5
PERCENT = 75
STRIDE = 4
WIDTH = STRIDE + WORDS - 1
BANDS = 48

# The notices' public wording.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "isc-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "mit": "Released under the MIT License.",
    "mit-header": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
MARKERS = "licens|permission|permitted|software|modif|redistribut|hereby"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_shingles(text: str) -> list[str]:
    """Distinct shingles of a template in order."""
    words = re.findall("[a-z0-9]+", text.lower())
    return list(dict.fromkeys(" ".join(words[i : i + WORDS]) for i in range(len(words) - WORDS + 1)))


SHINGLES = {name: template_shingles(text) for name, text in sorted(TEMPLATES.items())}
for _name, _own in SHINGLES.items():
    if not _own or 100 * sum(not re.search(MARKERS, s) for s in _own) >= PERCENT * len(_own):
        raise ValueError(f"the markers do not cover {_name}")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _bands(shingles: Column) -> Column:
    """Band keys of all windows of an array of shingle hashes."""
    band = F.sequence(F.lit(1), F.lit(BANDS))
    at = F.sequence(F.lit(1), F.size(shingles), F.lit(STRIDE))
    # elements are fetched one by one: a slice inside a function copies the whole array each time
    window = lambda i: F.array_compact(F.array(*[F.get(shingles, i - 1 + k) for k in range(STRIDE)]))
    return F.flatten(F.transform(at, lambda i: _let(window(i), lambda w: F.transform(band, lambda b: F.array_min(F.transform(w, lambda s: F.xxhash64(s, b)))))))


def template_keys(spark: SparkSession) -> dict[str, list[int]]:
    """Band keys under which each template is filed: those of its windows, one from each shingle on."""
    band = F.sequence(F.lit(1), F.lit(BANDS))

    def filed(own: list[str]) -> Column:
        hashes = F.array(*[F.xxhash64(F.lit(s)) for s in own])
        at = F.sequence(F.lit(1), F.lit(max(1, len(own) - STRIDE + 1)))
        return F.flatten(F.transform(at, lambda i: _let(F.slice(hashes, i, STRIDE), lambda w: F.transform(band, lambda b: F.array_min(F.transform(w, lambda s: F.xxhash64(s, b)))))))

    found = spark.range(1).select(*[filed(own).alias(name) for name, own in SHINGLES.items()]).first().asDict()
    return {name: sorted(set(keys)) for name, keys in found.items()}


def _any_of(array: str, keys: list[int]) -> Column:
    return F.exists(array, lambda b: b.isin(keys))


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_templates, templates (names in order, joined by commas) of every row of ``docs``.

    Null, empty and short texts match nothing; texts of any length are read whole.  Rows are independent, so null and repeated
    ids and repeated rows need no rule.  An empty table gives an empty result; extra columns are ignored.
    """
    keys = template_keys(docs.sparkSession)
    low = F.translate(F.coalesce(F.col(text), F.lit("")), _UP, _LOW)
    marked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.when(low.rlike(MARKERS), low).alias("low"))
    words = F.filter(F.split("low", "[^a-z0-9]+"), lambda w: w != "")
    cut = marked.select("doc_id", words.alias("words"))
    at = F.when(F.size("words") >= WORDS, F.sequence(F.lit(1), F.size("words") - (WORDS - 1)))
    cut = cut.select("doc_id", F.transform(at, lambda i: F.concat_ws(" ", *[F.get("words", i - 1 + k) for k in range(WORDS)])).alias("shingles"))
    every = sorted({k for own in keys.values() for k in own})
    hashed = cut.select("doc_id", "shingles", F.transform("shingles", lambda s: F.xxhash64(s)).alias("hashes"))
    met = F.array_distinct(F.filter(_bands(F.col("hashes")), lambda b: b.isin(every)))
    found = hashed.select("doc_id", "shingles", met.alias("met"))
    hits = []
    for name, own in SHINGLES.items():
        holds = F.size(F.array_intersect("shingles", F.array(*map(F.lit, own)))) * 100 >= PERCENT * len(own)
        hits.append(F.when(F.when(_any_of("met", keys[name]), holds), F.lit(name)))
    names = F.when(F.size("met") > 0, F.array_compact(F.array(*hits)))
    out = found.select("doc_id", F.coalesce(names, F.array().cast("array<string>")).alias("names"))
    return out.select("doc_id", F.size("names").cast("long").alias("n_templates"), F.array_join("names", ",").alias("templates"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _quoted(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


OP9_SQL = f"""
WITH t(name, own) AS (VALUES {", ".join(f"('{n}', {_quoted(s)})" for n, s in SHINGLES.items())}),
w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^a-z0-9]+'), lambda x : x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(list_transform(range(1, len(w) - {WORDS - 2}), lambda i : array_to_string(w[i:i + {WORDS - 1}], ' '))) AS s FROM w),
m AS (SELECT doc_id, name FROM s, t WHERE 100 * len(list_intersect(s, own)) >= {PERCENT} * len(own))
SELECT d.doc_id, count(name) AS n_templates, coalesce(string_agg(name, ',' ORDER BY name), '') AS templates
FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id GROUP BY d.doc_id
"""
