"""Rows that share an id, lack one or carry clashing columns, in the stages that remove rows; ids of composed letters."""

import unicodedata

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F

from linkengine.llm import exact_dedup, near_dedup, packing

SCHEMA = "doc_id long, text string, digest string, keep_id string, gone_id string, key string"


def table(spark, rows):
    return spark.createDataFrame([(d, t, "d", "k", "g", "y") for d, t in rows], SCHEMA)


def left(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def plain_copies(rows):
    """The row that stays of each group of equal texts: the largest id, none only where there is no other."""
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", set()).add(d)
    return [(max(ids - {None}, default=None), t) for t, ids in groups.items()]


def test_copies_go_by_id_and_text(spark):
    rows = [(5, "only A here"), (5, "shared B"), (9, "shared B"), (9, "shared B"), (None, "shared B"), (None, "alone"), (None, "alone"), (1, None), (2, "")]
    docs = table(spark, rows)
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns
    assert sorted([(d, t or "") for d, t in left(out)], key=str) == sorted(plain_copies(rows), key=str)
    assert {t for _, t in rows if t} == {t for _, t in left(out) if t}  # no content is lost
    assert exact_dedup.drop_copies(docs.limit(0)).count() == 0


def test_near_copies_go_by_id_and_text(spark):
    long = " ".join(f"w{i}" for i in range(60))
    near = long + " more"
    rows = [(5, "only A is here and nowhere else today"), (5, near), (3, long), (8, near), (None, near), (7, None), (7, "")]
    docs = table(spark, rows)
    out = near_dedup.drop_near(docs)
    assert out.columns == docs.columns
    assert left(out) == sorted([(5, rows[0][1]), (3, long), (7, None), (7, "")], key=str)
    assert near_dedup.drop_near(docs.limit(0)).count() == 0


def test_ids_of_composed_letters():
    tok = packing.SliceTokenizer(P.path("word_bpe_49k.json"))
    marks = [c for c in range(0x300, 0x370)] + [0x591, 0x64B, 0x93C, 0x1AB0, 0x20D0, 0x3099, 0xFE20]
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    texts = [f"x {a}{chr(m)}b {a}" for a in letters for m in marks]
    texts += [f"x {chr(c)}A {chr(c).upper()}" for c in range(0x80, 0x3000) if unicodedata.category(chr(c))[0] != "C"]
    want = [e.ids + [0] for e in tok.tokenizer.encode_batch(texts, add_special_tokens=False)]
    got = [np.frombuffer(x, "<u4").tolist() for x in tok.batch([t.encode() for t in texts])]
    assert got == want


def test_a_very_long_text_is_packed_whole(spark):
    docs = spark.createDataFrame([(1, "word " * 300_000), (2, "x")], "doc_id long, text string").withColumn("offset", F.lit("o"))
    rows = packing.pack_documents(docs, P.path("word_bpe_49k.json")).collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == 300_001 and len({r.sequence_id for r in rows}) == -(-300_003 // 2048)


def test_only_new_words_of_plain_slices_are_encoded():
    tok = packing.SliceTokenizer(P.path("word_bpe_49k.json"))
    asked = []

    class Words:
        def encode_batch_fast(self, texts, **kw):
            asked.extend(texts)
            return real.encode_batch_fast(texts, **kw)

    real, tok.words = tok.words, Words()
    texts = ["Word, word. (word) Straße STRASSE it's 42 <|endoftext|> </w>", "Word! word? Straße; É'LL \u212a x\u0301", " \t ", ""]
    want = [tok.tokenizer.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for t in texts for x in tok.batch([t.encode()])] == want
    words = " ".join(asked).split()
    assert words.count("word") == 1 and words.count("straße") == 1 and "word," not in words
    assert [np.frombuffer(x, "<u4").tolist() for x in tok.batch([t.encode() for t in texts])] == want
