"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors with cosine >= t differ by at most D = 2 - 2t in squared distance.  Vectors are rotated by one fixed random
orthogonal matrix and cut into ``BLOCKS`` blocks; for a linked pair at least one block differs by at most D / BLOCKS.  Each
block is range-joined under that budget: a vector lives in the grid cell of its first coordinates in the block, and visits
every cell that its ball of radius sqrt(D / BLOCKS) touches.  Cells are two radii wide, so a visit touches two cells for a
coordinate.  The number of grid coordinates follows the size of the label, so that cells keep about ``CELL`` vectors at
any size, and a visit to a cell that the ball does not reach is not made.  The union of what the blocks find is verified exactly, in double precision, on the vectors themselves; a pair
that several blocks find counts in the first of them.

Copies of one vector join once, with their count.  A cell returns a row per visitor (its links) and a spanning forest of
its links, never its pairs; a cell of more than ``SPLIT`` residents is dealt in parts, and so are its visitors: each part of
the one meets each part of the other, and no task holds more than a part of both.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .store import Store, partitions

COSINE = 0.98
BLOCKS = 8
CELL = 1024
SPLIT = 4096
#: Share of a label's vectors that a visit keeps for each grid coordinate, used only to choose how many there are.
KEEP = 0.35
#: Added to the block budgets against rounding; candidates only, the verification is exact.
SLACK = 1e-9


def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(4242)).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _blocks(d: int) -> list[np.ndarray]:
    return [b for b in np.array_split(np.arange(d), BLOCKS) if len(b)]


def _unpack(raw: list[bytes], kind: str) -> np.ndarray:
    """Rows of doubles; vectors travel in the type they came in, which loses nothing."""
    return np.frombuffer(b"".join(raw), kind).astype(np.float64).reshape(len(raw), -1)


def _valid(kind: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """id, packed vector; null where the vector links with nothing."""
        for b in batches:
            out = []
            for v in b.column(1):
                x = None
                if v.is_valid and v.values.null_count == 0 and len(v.values):
                    x = np.asarray(v.values, kind) + 0  # -0.0 becomes 0.0
                    if not np.isfinite(x).all() or not x.any():
                        x = None
                out.append(None if x is None else x.astype(kind).tobytes())
            yield pa.record_batch([b.column(0), pa.array(out, pa.binary()), b.column(2)], names=["vec_id", "vec", "label"])

    return run


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _visits(cosine: float, kind: str, homes: bool):
    """All visits of a vector's balls to cells, with the vectors; or only the label and cell of each ``homes``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn: dict[int, np.ndarray] = {}
        for b in batches:
            raw, dims = b.column(1).to_pylist(), b.column(3).to_numpy()
            size = np.array([len(x) // np.dtype(kind).itemsize for x in raw])
            for d in np.unique(size):
                rows = np.flatnonzero(size == d)
                turn.setdefault(int(d), rotation(int(d)))
                y = _units(_unpack([raw[i] for i in rows], kind)) @ turn[int(d)]
                blocks = _blocks(int(d))
                r = np.sqrt((2 - 2 * cosine) / len(blocks) + SLACK)
                for k, own in enumerate(blocks):
                    for g in np.unique(dims[rows]):
                        part = rows[dims[rows] == g]
                        z = y[np.searchsorted(rows, part)][:, own[: max(1, min(int(g), len(own)))]] / (2 * r)
                        home = np.floor(z).astype(np.int64)
                        low = np.floor(z - 0.5).astype(np.int64)  # the ball touches cells low and low + 1
                        for side in range(1 << z.shape[1]):
                            cell = low + np.array([side >> j & 1 for j in range(z.shape[1])])
                            away = np.maximum(np.maximum(cell - z, z - cell - 1), 0)
                            reached = (away * away).sum(axis=1) <= 0.25 + SLACK  # the ball's radius is half a cell
                            own_part, cell = part[reached], cell[reached]
                            key = np.full(len(cell), (k * 1000 + d), np.int64)
                            for j in range(z.shape[1]):
                                key = key * np.int64(1_000_003) + cell[:, j]
                            at_home = (cell == home[reached]).all(axis=1)
                            if homes:
                                yield pa.record_batch([b.column(2).take(pa.array(own_part[at_home])), pa.array(key[at_home])], names=["label", "cell"])
                                continue
                            i = pa.array(own_part)
                            yield pa.record_batch(
                                [b.column(0).take(i), b.column(1).take(i), b.column(2).take(i), b.column(4).take(i), pa.array(np.full(len(own_part), k, np.int32)), pa.array(key), pa.array(at_home)],
                                names=["id", "vec", "label", "w", "block", "cell", "home"],
                            )

    return run


def _merged(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``label``, the least index of each index's group, after the links u to v."""
    while True:
        a, b = np.minimum(label[u], label[v]), np.maximum(label[u], label[v])
        if (a == b).all():
            return label
        label = label.copy()
        np.minimum.at(label, b[a < b], a[a < b])
        while (label[label] != label).any():
            label = label[label]


def _links(cosine: float, kind: str):
    def cell(t: pa.Table) -> pa.RecordBatch:
        x = _unpack(t.column("vec").to_pylist(), kind)
        block = t.column("block")[0].as_py()
        ids, w = t.column("id").to_numpy(), t.column("w").to_numpy()
        h, guests = (np.flatnonzero(t.column(c).to_numpy(zero_copy_only=False)) for c in ("home", "guest"))
        unit = _units(x)
        y = unit @ rotation(x.shape[1])
        parts = _blocks(x.shape[1])
        budget = (2 - 2 * cosine) / len(parts) + SLACK
        norm = np.sqrt((x * x).sum(axis=1))
        scaled = np.isfinite(norm).all() and (norm > 1e-150).all()
        links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))

        def square(i: np.ndarray, j: np.ndarray, own: np.ndarray) -> np.ndarray:
            a, c = y[i][:, own], y[j][:, own]
            return (a * a).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * a @ c.T

        for r in range(0, len(guests), 512):
            i = guests[r : r + 512]
            for q in range(0, len(h), 2048):
                p, s = np.nonzero(square(i, h[q : q + 2048], parts[block]) <= budget)
                p, s = i[p], h[q : q + 2048][s]
                p, s = p[p != s], s[p != s]
                for a in range(0, len(p), 20_000):
                    pp, ss = p[a : a + 20_000], s[a : a + 20_000]
                    if scaled:
                        ok = (x[pp] * x[ss]).sum(axis=1) / (norm[pp] * norm[ss]) >= cosine
                    else:
                        ok = (unit[pp] * unit[ss]).sum(axis=1) >= cosine
                    pp, ss = pp[ok], ss[ok]
                    label = _merged(label, pp, ss)
                    first = np.ones(len(pp), bool)  # no earlier block found the pair
                    for own in parts[:block]:
                        diff = y[pp][:, own] - y[ss][:, own]
                        first &= (diff * diff).sum(axis=1) > budget
                    np.add.at(links, pp[first], w[ss[first]])
        keep = (links > 0) | (label != np.arange(len(ids)))
        return pa.record_batch([pa.array(ids[keep]), pa.array(links[keep]), pa.array(ids[label][keep])], names=["id", "links", "near"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            key = list(zip(*[b.column(c).to_pylist() for c in ("label", "cell", "part", "guests")], strict=True))
            a = 0
            for i in range(1, len(key) + 1):
                if i == len(key) or key[i] != key[a]:
                    if key[a] != last and held:
                        yield cell(pa.Table.from_batches(held))
                        held = []
                    last = key[a]
                    held.append(b.slice(a, i - a))
                    a = i
        if held:
            yield cell(pa.Table.from_batches(held))

    return run


def embedding_dedup(vectors: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Vectors are compared only under equal, non-null labels and equal length; a vector that is null, empty, zero or holds
    null or non-finite components links with nothing.  Repeated rows count as vectors of their own; rows that share an id
    share its component.  A null id takes part in links but has itself as component where it has none.  An empty table gives
    an empty result; extra columns are ignored.
    """
    spark = vectors.sparkSession
    store, n = Store(spark, "embeddings"), partitions(vectors.sparkSession)
    kind = "<f4" if dict(vectors.dtypes)[embedding] == "array<float>" else "<f8"
    typed = F.col(embedding) if kind == "<f4" else F.col(embedding).cast("array<double>")
    own = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), typed.alias("e"), F.col(label).cast("string").alias("label"))
    rows = own.mapInArrow(_valid(kind), "vec_id long, vec binary, label string")
    key = F.when(F.col("vec").isNotNull() & F.col("label").isNotNull(), F.xxhash64("label", "vec")).alias("id")
    rows = store.save(rows.select("vec_id", "vec", "label", key), "rows")
    alone = rows.where("id is not null").groupBy("id", "label", "vec").agg(F.count("*").alias("w"), F.min("vec_id").alias("least"))
    alone = store.save(alone, "distinct")
    size = alone.groupBy("label").agg(F.count("*").alias("m"))
    grid = F.greatest(F.lit(1), F.ceil(F.log(F.col("m") / CELL) / -float(np.log(KEEP)))).cast("int").alias("dims")
    deal = alone.join(size, "label").select("id", "vec", "label", grid, "w")
    deal = deal.repartition(n)
    homes = deal.mapInArrow(_visits(cosine, kind, True), "label string, cell long").groupBy("label", "cell").count()
    parts = store.save(homes.where(f"count > {SPLIT}").select("label", "cell", F.ceil(F.col("count") / SPLIT).cast("int").alias("parts")), "parts")
    visits = deal.mapInArrow(_visits(cosine, kind, False), "id long, vec binary, label string, w long, block int, cell long, home boolean")
    dealt = visits.join(parts, ["label", "cell"], "left").withColumn("parts", F.coalesce(F.col("parts").cast("long"), F.lit(1).cast("long")))
    dealt = dealt.withColumns({"own": F.expr("pmod(xxhash64(id), parts)"), "as": F.expr("pmod(xxhash64(id, 1), parts)")})
    # a resident meets all parts of the visitors, a visitor all parts of the residents
    meets = "transform(sequence(0L, parts - 1L), k -> struct(k AS part, `as` AS guests, home AND k = own AS home, true AS guest))"
    stays = "transform(filter(sequence(0L, parts - 1L), k -> home AND k <> `as`), k -> struct(own AS part, k AS guests, true AS home, false AS guest))"
    dealt = dealt.withColumn("at", F.explode(F.expr(f"concat({meets}, {stays})"))).select("id", "vec", "label", "w", "block", "cell", "at.*")
    cells = dealt.repartition(n, "label", "cell", "part", "guests").sortWithinPartitions("label", "cell", "part", "guests")
    links = cells.select("id", "vec", "label", "w", "block", "cell", "home", "part", "guests", "guest").mapInArrow(_links(cosine, kind), "id long, links long, near long")
    found = store.save(links, "found")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("id").alias("u"), F.col("near").alias("v")), store)
    named = alone.select("id", "w", "least").join(links, "id", "left").join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = named.join(least, "comp").select("id", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id")
    c = F.coalesce("component_id", "vec_id")
    return rows.select("vec_id", "id").join(named, "id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), c.alias("component_id"), F.col("vec_id").eqNullSafe(c).alias("kept"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
