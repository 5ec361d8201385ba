"""Exact, near and substring dedup, embedding dedup against plain versions, with odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkengine.llm import embedding_dedup, exact_dedup, graph, near_dedup, substring_dedup, textkit
from linkengine.llm.store import Store

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=3, n=60):
    """Documents with exact and near copies, shared passages, nulls, empties, a long text, repeated rows and clashing columns."""
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    make = lambda k: [rng.choice(words) for _ in range(k)]
    passage = make(40)
    texts = []
    for i in range(n):
        kind = i % 6
        if kind == 0 and texts:
            texts.append(rng.choice(texts))
        elif kind == 1 and texts:
            t = rng.choice(texts).split()
            for _ in range(max(1, len(t) // 60)):
                if t:
                    t[rng.randrange(len(t))] = rng.choice(words).upper()
            texts.append(" ".join(t))
        elif kind == 2:
            texts.append(" ".join(make(rng.randint(0, 30)) + passage + make(rng.randint(0, 30))))
        else:
            texts.append("\t".join(make(rng.randint(1, 120))) + "\n")
    texts += [None, "", "   \n", "one", "one two three four", " ".join(make(3000)), "É é x y z w v"]
    rows = [(i * 7 % 1009, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (rows[5][0], "another text under a used id " + " ".join(make(20)), None, None, None), (None, texts[4], None, None, None), (None, None, None, None, None)]
    rng.shuffle(rows)
    return rows


def extra(df):
    return df.withColumns({"kept": F.lit(1), "node": F.lit("x"), "hashes": F.lit(2)})


def plain_sets(rows):
    out = []
    for _, t, *_ in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def test_exact(spark):
    rows = corpus()
    got = exact_dedup.exact_dedup(extra(spark.createDataFrame(rows, SCHEMA))).collect()
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(t or "", []).append(d)
    want = []
    for d, t, *_ in rows:
        g = groups[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        want.append((d, keep, len(g), d == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_near(spark):
    rows = corpus()
    sets = plain_sets(rows)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            known = rows[i][0] is not None and rows[j][0] is not None
            if sets[i] and (sets[i] == sets[j] or (known and 100 * both >= 75 * len(sets[i] | sets[j]))):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if sets[i] and r[0] is not None:
            least[find(i)] = min(least.get(find(i), 1 << 60), r[0])
    want = []
    for i, r in enumerate(rows):
        c = least.get(find(i), r[0]) if sets[i] else r[0]
        want.append((r[0], len(sets[i]), c, r[0] == c))
    got = near_dedup.near_dedup(extra(spark.createDataFrame(rows, SCHEMA))).collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_near_large_nodes(spark, monkeypatch):
    """Small limits send a group of near copies through branching and block pairs."""
    monkeypatch.setattr(near_dedup, "SMALL", 8)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = random.Random(9)
    base = ["v%d" % rng.randrange(900) for _ in range(200)]
    rows = []
    for i in range(60):
        t = list(base)
        t[rng.randrange(200)] = f"z{i}"
        rows.append((i, " ".join(t), None, None, None))
    got = near_dedup.near_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def plain_substring(rows):
    words = [WORD.findall(t or "") for _, t, *_ in rows]
    first = {}
    for (d, *_), w in zip(rows, words, strict=True):
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            if d is not None and (k not in first or d < first[k]):
                first[k] = d
    out = []
    for (d, *_), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - 12):
            if d is not None and first[tuple(w[i : i + 13])] < d:
                gone.update(range(i, i + 13))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_substring(spark):
    rows = corpus(5, 90)
    got = substring_dedup.substring_dedup(extra(spark.createDataFrame(rows, SCHEMA)), keep_text=False).collect()
    want = plain_substring(rows)
    assert sum(w[2] for w in want) > 500
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_cover():
    for i in range(7):
        for j in range(7):
            assert any((i + k) % 7 in substring_dedup.COVER and (j + k) % 7 in substring_dedup.COVER for k in range(7))


@pytest.mark.parametrize("f, columns", [(exact_dedup.exact_dedup, 5), (near_dedup.near_dedup, 4), (substring_dedup.substring_dedup, 5)])
def test_empty_tables(spark, f, columns):
    df = f(spark.createDataFrame([], SCHEMA))
    assert len(df.columns) == columns and df.count() == 0


def test_kept_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "en", "s", 1), (2, "a b c d e f", "en", "s", 2), (3, "A b c d e f", "en", "s", 3)], SCHEMA)
    once = exact_dedup.drop_copies(docs)
    assert sorted(r.doc_id for r in once.collect()) == [2, 3] and once.columns == docs.columns
    assert [r.doc_id for r in near_dedup.drop_near(once).collect()] == [2]


def test_cuckoo():
    rng = random.Random(2)
    index, live = exact_dedup.CuckooIndex(2), {}
    for step in range(6000):
        key = hashlib.sha256(str(rng.randrange(1500)).encode()).digest()
        if key in live and rng.random() < 0.5:
            assert index.delete(key)
            del live[key]
        elif key not in live:
            assert index.get(key) is None
            index.insert(key, step)
            live[key] = step
    assert dict(index.items()) == live and index.size == len(live) and index.resizes > 3
    assert all(index.get(k)[1] == v for k, v in live.items()) and not index.delete(b"0" * 32)


def test_maintain(spark):
    d = lambda *xs: spark.createDataFrame([(x.encode(),) for x in xs], "digest binary")
    live = d("a", "b").withColumn("n", F.lit(1).cast("long"))
    out = exact_dedup.maintain(live, d("b", "c"), d("a", "b", "zz"))
    assert sorted((bytes(r.digest), r.n) for r in out.collect()) == [(b"b", 1), (b"c", 1)]


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5)]
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.id: r.comp for r in graph.components(spark.createDataFrame(edges, "u long, v long"), Store(spark, "t")).collect()}
    assert got == {i: find(i) for a, b in edges if a != b for i in (a, b)}


def test_rounds_of_components_write_few_files(spark):
    """On local disks a file costs two processes, which count as the executor's memory over again until they run a program of their own."""
    files, held = {}, {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in held}

    class Counted(Store):
        def save(self, df, tag, *more):
            out = super().save(df, tag, *more)
            files.setdefault(tag, []).append(len(out.inputFiles()))
            return out

    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = {r.id: r.comp for r in graph.components(spark.range(500).selectExpr("id AS u", "id + 500 * (1 + id % 3) AS v"), Counted(spark, "t")).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(got) == 1000 and all(got[i] == i == got[i + 500 * (1 + i % 3)] for i in range(500))
    assert max(files["large"] + files["star"]) <= spark.sparkContext.defaultParallelism < 24


def test_word_hashes():
    import pyarrow as pa

    texts = ["a b  a", None, "", "é a\n", "b" * 50]
    data, off = textkit.buffers(pa.array(texts))
    h, first = textkit.word_hashes(data, off)
    assert first.tolist() == [0, 3, 3, 3, 5, 6] and h[0] == h[2] == h[4] and len(set(h.tolist())) == 4


def vectors(seed=1):
    rng = np.random.default_rng(seed)
    rows, centre = [], rng.normal(size=(4, 64))
    for i in range(240):
        v = centre[i % 4] + rng.normal(size=64) * (0.1 if i % 3 else 1.0)
        rows.append((i, [float(x) for x in v.astype(np.float32)], i % 2))
    rows += [(500, rows[0][1], 0), (501, rows[0][1], 0), (502, rows[0][1], 1), (503, rows[0][1], None), (504, None, 0), (505, [0.0] * 64, 0), (506, [float("nan")] * 64, 0), (507, [None] * 64, 0), (508, [], 0), (509, [1.0, 2.0], 0), (510, [2.0, 4.0], 0), (4, rows[4][1], 0)]
    return rows


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL", 16)
    monkeypatch.setattr(embedding_dedup, "SPLIT", 32)
    rows = vectors()
    ok = [v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and np.any(v) for _, v, _ in rows]
    link = [set() for _ in rows]
    for i, (_, v, a) in enumerate(rows):
        for j, (_, w, b) in enumerate(rows):
            if i != j and ok[i] and ok[j] and a is not None and a == b and len(v) == len(w):
                x, y = np.array(v), np.array(w)
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.98:
                    link[i].add(j)
    comp = list(range(len(rows)))
    while True:
        new = [min([comp[i], *(comp[j] for j in link[i])], key=lambda k: rows[k][0]) for i in range(len(rows))]
        if new == comp:
            break
        comp = new
    want = [(r[0], len(link[i]), rows[comp[i]][0], r[0] == rows[comp[i]][0]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("links", F.lit(1))
    got = embedding_dedup.embedding_dedup(df).collect()
    assert sum(w[1] for w in want) > 300
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0
