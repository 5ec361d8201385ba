"""Near-duplicate join of shingle sets by chosen paths.

Documents with one shingle set form a class; the join works on classes.  A tree branches its classes by chosen minwise
tokens: the child of a node is (node, chosen coordinate, value there), so two classes follow one branch with a probability
equal to their Jaccard similarity.  There are ``ROOTS`` trees.  Each has a root coordinate and ``OWN`` further ones that no
other tree uses, level by level as many as ``BRANCHES`` says, so that trees are independent and no level repeats a value.  A
node of at most ``SMALL`` classes is compared exhaustively; a larger one branches again, and one that is still large at the
end is compared exhaustively too, cut into pairs of blocks so that no task holds all of it.

Recall: a link of similarity s survives a tree with a probability of s where its nodes are small, and of
s (1 - (1 - s)^3) (1 - (1 - s)^2) where they are large at every level; for s = 0.75 that is 0.692, so that all trees miss it
with at most 0.308^8 = 8.1e-5, and with 0.25^8 = 1.6e-5 without large nodes.
Nodes compare sketches of four bits from each of ``SKETCH`` minwise values.  Two classes of similarity s agree at a share of
s + (1 - s) / 16 of them; ``CUT`` is that share for s = 0.75 less four standard deviations, which 0.5 does not reach.
The sketch is the same in all trees: a link at 0.75 has fewer than 169 of 256 agreements with a probability of 4.9e-5 and is
then missed in every tree.  Together at most 1.3e-4 of the links at the threshold itself are missed, fewer above it.

A node returns no pairs but a spanning forest of those that agree, so its rows grow with its members.  The trees of all
forests are families; each class belongs to one.  Inside a family all pairs are compared exactly on the full shingle sets,
again by pairs of blocks, each block pair returning a spanning forest of its confirmed links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit
from .graph import components
from .store import Store, partitions

WORDS = 5
PERCENT = 75
SKETCH = 256
ROOTS = 8
#: Branches of a large node, level by level, each along a coordinate of its tree's own.
BRANCHES = (3, 2)
OWN = sum(BRANCHES)
#: Minwise values that are kept whole: the roots', then each tree's own.
K = ROOTS * (1 + OWN)
SMALL = 2048
#: Classes of a family in one block.
BLOCK = 256
CUT = 0.66
#: Columns of the incidence matrix multiplied at once.
WIDE = 4096

_A = np.random.Generator(np.random.PCG64(77)).integers(1, 2**62, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SIG = "doc_id long, key long, n_shingles long, cid long, sk array<int>, sketch binary"


def _class_id(x: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, cid, sk, sketch = [], [], [], []
        for x in textkit.shingle_sets(b.column(1), WORDS):
            n.append(len(x))
            cid.append(_class_id(x) if len(x) else None)
            if len(x):
                least = np.full(SKETCH, 2**64 - 1, np.uint64)
                for a in range(0, len(x), 512):
                    least = np.minimum(least, (_A[:, None] * x[None, a : a + 512]).min(axis=1))
                least >>= np.uint64(32)
                sk.append(least[:K].astype(np.uint32).view(np.int32))
                low = (least & np.uint64(15)).astype(np.uint8)
                sketch.append((low[0::2] | low[1::2] << 4).tobytes())
            else:
                sk.append(None)
                sketch.append(None)
        flat = np.concatenate([s for s in sk if s is not None] or [np.zeros(0, np.int32)])
        off = np.concatenate([[0], np.cumsum([0 if s is None else K for s in sk])]).astype(np.int32)
        mask = np.array([s is None for s in sk] + [False])
        lists = pa.ListArray.from_arrays(pa.array(off, pa.int32(), mask=mask), pa.array(flat, pa.int32()))
        yield pa.record_batch([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(cid, pa.int64()), lists, pa.array(sketch, pa.binary())], names=["doc_id", "key", "n_shingles", "cid", "sk", "sketch"])


def text_key(text: str):
    """Tells the texts of rows that share an id apart."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def signatures(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), text_key(text).alias("key")).mapInArrow(_sketch, _SIG)


def _roots() -> Column:
    """For each tree its node at the root and the values of its own."""
    one = lambda t: F.struct(F.xxhash64(F.lit(t), F.element_at("sk", t + 1)).alias("node"), F.slice("sk", ROOTS + OWN * t + 1, OWN).alias("own"))
    return F.array(*map(one, range(ROOTS)))


def _children(level: int) -> Column:
    """The nodes into which a row of a large node goes at a level, along the coordinates of that level."""
    first = sum(BRANCHES[:level])
    return F.array(*[F.xxhash64("node", F.lit(c), F.element_at("own", c + 1)) for c in range(first, first + BRANCHES[level])])


def _large(rows: DataFrame) -> DataFrame:
    """The nodes of more than ``SMALL`` classes."""
    return rows.groupBy("node").agg(F.count("*").alias("m")).where(f"m > {SMALL}").select("node")


def leaves(classes: DataFrame, store: Store) -> DataFrame:
    """Rows (node, lo, hi, cid, n, sketch) of the nodes to compare; blocks lo and hi are compared with each other.

    Rows of small nodes go on with their sketches; only large nodes are joined and branched again.
    """
    zero = F.lit(0)
    done, rows = None, classes.select(F.explode(_roots()).alias("at"), "cid", "n", "sketch").select("at.node", "at.own", "cid", "n", "sketch")
    for level in range(len(BRANCHES) + 1):
        if level:
            rows = store.save(rows.select(F.explode(_children(level - 1)).alias("node"), "own", "cid", "n", "sketch"), "level")
        large = store.save(_large(rows), "large")
        part = rows.join(large, "node", "left_anti").select("node", zero.alias("lo"), zero.alias("hi"), "cid", "n", "sketch")
        done = part if done is None else done.unionByName(part)
        if large.isEmpty():
            return done
        rows = rows.join(large, "node", "left_semi")
    return done.unionByName(_block_pairs(rows.select("node", "cid", "n", "sketch"), SMALL).select("node", "lo", "hi", "cid", "n", "sketch"))


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that hold whole (node, lo, hi) groups of a sorted partition."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        same = np.ones(b.num_rows, bool)
        for name in ("node", "lo", "hi"):
            v = b.column(name).to_numpy()
            same &= v == v[-1]
        cut = int(b.num_rows - np.argmin(same[::-1])) if not same.all() else 0
        if cut or (held and any(held[-1].column(c)[-1] != b.column(c)[0] for c in ("node", "lo", "hi"))):
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = [b.slice(cut)]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def _forest(near: np.ndarray) -> np.ndarray:
    """The least index reachable from each index of a symmetric matrix."""
    m = len(near)
    label = np.arange(m)
    while True:
        new = np.minimum(label, np.where(near, label[None, :], m).min(axis=1, initial=m))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the classes of each node whose sketches agree."""
    for t in _runs(batches):
        if not t.num_rows:
            continue
        col = {c: t.column(c).to_numpy() for c in ("node", "lo", "hi", "cid", "n")}
        packed = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH // 2)
        sk = np.concatenate([packed & 15, packed >> 4], axis=1)
        change = np.ones(len(sk) + 1, bool)
        change[1:-1] = (col["node"][1:] != col["node"][:-1]) | (col["lo"][1:] != col["lo"][:-1]) | (col["hi"][1:] != col["hi"][:-1])
        at = np.flatnonzero(change)
        size = np.diff(at)
        low, high = col["n"], col["cid"]
        two = at[:-1][size == 2]
        fits = 100 * np.minimum(low[two], low[two + 1]) >= PERCENT * np.maximum(low[two], low[two + 1])
        two = two[fits & ((sk[two] == sk[two + 1]).mean(axis=1) >= CUT)]
        out_u, out_v = [high[two]], [high[two + 1]]
        for a, m in zip(at[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
            x, n = sk[a : a + m], low[a : a + m]
            near = 100 * np.minimum(n[:, None], n[None, :]) >= PERCENT * np.maximum(n[:, None], n[None, :])
            for r in range(0, m, 32):
                near[r : r + 32] &= (x[r : r + 32, None, :] == x[None, :, :]).mean(axis=2) >= CUT
            label = _forest(near)
            own = np.flatnonzero(label != np.arange(m))
            out_u.append(high[a + own])
            out_v.append(high[a + label[own]])
        yield pa.record_batch([pa.array(np.concatenate(out_u)), pa.array(np.concatenate(out_v))], names=["u", "v"])


def _sorted_groups(rows: DataFrame) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), "node", "lo", "hi").sortWithinPartitions("node", "lo", "hi")


def _full(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cids, sets, seen = [], [], b.column(0).to_pylist()
        for cid, x in zip(seen, textkit.shingle_sets(b.column(1), WORDS), strict=True):
            if len(x) and _class_id(x) == cid:  # rows that repeat an id may hold another text
                cids.append(cid)
                sets.append(x.tobytes())
        for a in range(0, len(cids), 500):
            yield pa.record_batch([pa.array(cids[a : a + 500], pa.int64()), pa.array(sets[a : a + 500], pa.binary())], names=["cid", "hashes"])


def _confirm(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links of each block pair of a family, on full sets."""
    for t in _runs(batches):
        key = np.stack([t.column(c).to_numpy() for c in ("node", "lo", "hi")], axis=1)
        cid = t.column("cid").to_numpy()
        at = np.append(np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1))), len(key))
        raw = t.column("hashes").to_pylist()
        u, v = [], []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            sets = [np.frombuffer(x, np.uint64) for x in raw[a:b]]
            n = np.array([len(x) for x in sets])
            owner = np.repeat(np.arange(b - a), n)
            h = np.concatenate(sets)
            order = np.argsort(h, kind="stable")
            h, owner = h[order], owner[order]
            new = np.append(True, h[1:] != h[:-1]) if len(h) else np.zeros(0, bool)
            number = np.cumsum(new) - 1
            shared = np.bincount(number)[number] > 1 if len(h) else new
            owner, number = owner[shared], np.unique(number[shared], return_inverse=True)[1]
            both = np.zeros((b - a, b - a), np.float64)
            for c in range(0, int(number.max(initial=-1)) + 1, WIDE):
                x, y = np.searchsorted(number, [c, c + WIDE])
                part = np.zeros((b - a, WIDE), np.float32)
                part[owner[x:y], number[x:y] - c] = 1
                both += part @ part.T
            label = _forest(100 * both >= PERCENT * (n[:, None] + n[None, :] - both))
            own = np.flatnonzero(label != np.arange(b - a))
            u.append(cid[a + own])
            v.append(cid[a + label[own]])
        yield pa.record_batch([pa.array(np.concatenate(u or [np.zeros(0, np.int64)])), pa.array(np.concatenate(v or [np.zeros(0, np.int64)]))], names=["u", "v"])


def _block_pairs(members: DataFrame, block: int) -> DataFrame:
    """Rows (node, cid, ...) -> rows (node, lo, hi, cid, ...), one for each block pair that the row's block is in."""
    size = members.groupBy("node").agg(F.ceil(F.count("*") / block).cast("int").alias("nb"))
    own = F.pmod(F.xxhash64("cid"), F.col("nb")).cast("int").alias("own")
    dealt = members.join(size, "node").select("*", own).withColumn("other", F.explode(F.expr("sequence(0, nb - 1)")))
    return dealt.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("nb", "own", "other")


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Null or wordless texts have an empty set, link with nothing and stay.  Equal sets link; a null id takes no part in
    links between different sets, and its component is that of its set.  Repeated rows share their component and are both
    ``kept`` where it is theirs.  Texts of any length are read whole.  An empty table gives an empty result.  Extra columns
    are ignored.
    """
    return _marked(docs, doc_id, text).drop("key")


def _marked(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows of :func:`near_dedup` with the key of their text."""
    spark = docs.sparkSession
    store = Store(spark, "near")
    sig = store.save(signatures(docs, doc_id, text), "sig")
    cls = sig.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("rid"), F.first("n_shingles").alias("n"), F.first("sk").alias("sk"), F.first("sketch").alias("sketch"))
    cls = store.save(cls, "classes")
    agree = _sorted_groups(leaves(cls, store)).mapInArrow(_compare, "u long, v long")
    family = store.save(components(agree, store).join(cls.select(F.col("cid").alias("id"), "rid"), "id").where("rid is not null"), "family")
    source = docs.select(F.col(doc_id).cast("long").alias("rid"), F.col(text).cast("string").alias("text"))
    sets = source.join(family.hint("shuffle_hash"), "rid").select("id", "text").mapInArrow(_full, "cid long, hashes binary").dropDuplicates(["cid"])
    sets = store.save(sets, "sets")
    dealt = _block_pairs(family.select(F.col("comp").alias("node"), F.col("id").alias("cid")), BLOCK).join(sets, "cid")
    links = _sorted_groups(dealt.select("node", "lo", "hi", "cid", "hashes")).mapInArrow(_confirm, "u long, v long")
    comp = components(links, store)
    top = cls.select("cid", "rid").join(comp.select(F.col("id").alias("cid"), F.col("comp").alias("c")), "cid", "left").withColumn("c", F.coalesce("c", "cid"))
    least = top.groupBy("c").agg(F.min("rid").alias("component_id"))
    named = store.save(top.join(least, "c").select("cid", "component_id"), "named")
    return sig.select("doc_id", "key", "n_shingles", "cid").join(named, "cid", "left").select(
        "doc_id", "key", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.coalesce("component_id", "doc_id")).alias("kept"),
    )


def drop_near(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each near-duplicate group; all columns stay, whatever their names.

    Rows go by id and text together: one that shares its id with a near copy but not its text stays.  Rows that repeat both
    stay or go together, and so do rows without an id.  An empty table gives an empty result.
    """
    gone = _marked(docs, "doc_id", "text").where(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(gone["gone_id"]) & (text_key("text") == gone["gone_key"])
    return docs.join(gone.hint("shuffle_hash"), same, "left_anti")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
