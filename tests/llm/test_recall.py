"""Recall near the threshold when every node is large, hot nodes of the component graph, hot cells of embeddings."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkengine.llm import embedding_dedup, graph, near_dedup
from linkengine.llm.store import Store


def jaccard(a, b):
    return len(a & b) / len(a | b)


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


@pytest.mark.parametrize("small", [2048, 0])
def test_links_near_the_threshold(spark, monkeypatch, small):
    """With ``SMALL`` at 0 every node branches at every level and is compared in blocks."""
    monkeypatch.setattr(near_dedup, "SMALL", small or 1)
    if not small:
        monkeypatch.setattr(near_dedup, "_large", lambda rows: rows.select("node").distinct())
    rng = random.Random(3)
    rows, linked, far = [], 0, 0
    for i in range(300):
        words = [f"{rng.randrange(10**6)}" for _ in range(120)]
        other = words[: rng.choice((103, 104, 105, 106, 97, 96))]
        other += [f"{rng.randrange(10**6)}" for _ in range(120 - len(other))]
        s = jaccard(shingles(words), shingles(other))
        linked += s >= 0.75
        far += s < 0.75
        rows += [(2 * i, " ".join(words), s >= 0.75), (2 * i + 1, " ".join(other), s >= 0.75)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, near boolean")
    out = {r.doc_id: r.component_id for r in near_dedup.near_dedup(docs).collect()}
    met = sum(out[d] == d - 1 for d, _, near in rows if near and d % 2)
    assert linked > 100 and far > 50
    assert met >= 0.99 * linked
    assert all(out[d] == d for d, _, near in rows if not near)


def test_components_with_hot_nodes(spark, monkeypatch):
    monkeypatch.setattr(graph, "LEAST", 3)
    rng = random.Random(1)
    edges = [(0, i) for i in range(1, 200)] + [(1000, i) for i in range(500, 700)] + [(2000 + i, 2001 + i) for i in range(40)] + [(199, 650)]
    edges += [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(300)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.id: r.comp for r in graph.components(df, Store(spark, "test")).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}
    assert graph.components(df.limit(0), Store(spark, "test")).count() == 0


def test_hot_cells_are_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SPLIT", 7)
    monkeypatch.setattr(embedding_dedup, "CELL", 4)
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(6, 32))
    x = np.repeat(centre, 40, axis=0) + rng.normal(size=(240, 32)) * 0.14
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    np.fill_diagonal(near, False)
    rows = [(i, [float(v) for v in x[i]], "one") for i in range(240)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").withColumn("home", F.lit("x"))
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.embedding_dedup(df).collect()}
    label = np.arange(240)
    while True:
        new = np.minimum(label, np.where(near, label[None, :], 240).min(axis=1))
        if (new == label).all():
            break
        label = new
    assert near.sum() > 500
    assert got == {i: (int(near[i].sum()), int(label[i])) for i in range(240)}
