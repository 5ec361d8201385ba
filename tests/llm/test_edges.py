"""The pipeline on empty, null, repeated, clashing and long rows; license scans of repeated and long texts."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linkengine.llm import licenses

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, spans string, gap string, key string"
PROSE = {"en": "the house by the river was sold to the man who came with the boat and the old dog number {}", "fr": "la maison au bord de la riviere fut vendue avec le bateau et le vieux chien du voisin numero {}"}


def plain(rows):
    """(doc_id, text) of the rows that the first three stages keep, by their rules."""
    rows = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    best = {}
    for d, t in rows:
        best.setdefault(t, set()).add(d)
    rows = [(max(ids - {None}, default=None), t) for t, ids in best.items()]

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    kept = []
    for d, t in rows:
        a = shingles(t)
        near = [x for x, u in rows if (x, u) != (d, t) and x is not None and len(a & shingles(u)) * 100 >= 75 * len(a | shingles(u))]
        if not near or d == min([d, *near]):
            kept.append((d, t))
    return kept


@pytest.fixture(scope="module")
def rows():
    out = [(i, PROSE["en" if i % 2 else "fr"].format(f"{i} " * 3 + " ".join(f"w{i}x{k}" for k in range(40)))) for i in range(20)]
    near = out[4][1] + " tail"
    return [*out, (30, out[1][1]), (30, "only here under thirty"), (31, None), (32, ""), (33, " \n"), (34, "12 34"), (35, near), (35, "only here under thirty five"), (8, out[9][1]), (None, "a text without an id"), (40, "long " * 40_000), (41, "x"), (41, "x")]


def test_run_on_odd_rows(spark, tmp_path, rows):
    df = spark.createDataFrame([(d, t, "en" if (d or 0) % 2 else "fr", "s", len(t or ""), "d", "p", "g", "k") for d, t in rows], SCHEMA)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns, name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=str) == sorted(plain(rows), key=str)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({str(r.doc_id) for r in out}) == sorted({str(d) for d, _ in plain(rows)})


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and "sequence_id" in out.columns


def test_licenses_of_repeated_and_long_texts(spark):
    long = "word " * 60_000 + licenses.TEMPLATES["mit-text"] + " word" * 60_000
    cut = licenses.TEMPLATES["isc-text"].replace("ALL IMPLIED", "any implied")
    texts = [long, long, cut, licenses.TEMPLATES["bsd"].upper()]
    df = spark.createDataFrame([(1, t) for t in texts], "doc_id long, text string").withColumn("names", F.lit(1))
    assert sorted(r.templates for r in licenses.license_scan(df).collect()) == sorted(["mit-header,mit-text"] * 2 + ["isc,isc-text", "bsd"])
