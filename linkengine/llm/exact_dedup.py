"""Exact dedup by a cuckoo-filter index of live digests.

A bucket has four slots; a slot has a 16-bit fingerprint and, beside it, the stored content key (SHA-256 and the byte
length of the text).  A fingerprint hit is a candidate only: it counts after the stored key compares equal.  When an insert
finds no slot after ``MAX_KICKS`` moves, the table doubles and is rebuilt from the stored keys, so nothing is ever lost.
Deletion clears the verified slot.

Each task first folds its own rows into an index, so that a text held by a third of all rows leaves a task once; the
partial entries then meet in the index of their digest's partition.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import partitions

SLOTS = 4
MAX_KICKS = 200


class CuckooIndex:
    """Cuckoo filter over byte keys with the stored keys and a payload per key."""

    def __init__(self, buckets: int = 1 << 10):
        self.size, self.resizes = 0, 0
        self._alloc(1 << max(1, (buckets - 1).bit_length()))

    def _alloc(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.fp: list[list[int]] = [[] for _ in range(buckets)]
        self.held: list[list[list]] = [[] for _ in range(buckets)]

    @staticmethod
    def _mark(key: bytes) -> tuple[int, int]:
        return int.from_bytes(key[:2], "little") % 65535 + 1, int.from_bytes(key[2:10], "little")

    def _other(self, i: int, fp: int) -> int:
        return (i ^ (fp * 0x5BD1E995)) & self.mask

    def get(self, key: bytes) -> list | None:
        """The entry [key, payload] of a live key; the payload may be changed in place."""
        fp, h = self._mark(key)
        i = h & self.mask
        for b in (i, self._other(i, fp)):
            for f, entry in zip(self.fp[b], self.held[b], strict=True):
                if f == fp and entry[0] == key:
                    return entry
        return None

    def insert(self, key: bytes, payload) -> None:
        """Insert a key that is not live."""
        fp, h = self._mark(key)
        entry, i = [key, payload], h & self.mask
        if len(self.fp[i]) >= SLOTS:
            i = self._other(i, fp)
        for kick in range(MAX_KICKS):
            if len(self.fp[i]) < SLOTS:
                self.fp[i].append(fp)
                self.held[i].append(entry)
                self.size += 1
                return
            k = kick % SLOTS
            fp, self.fp[i][k] = self.fp[i][k], fp
            entry, self.held[i][k] = self.held[i][k], entry
            i = self._other(i, fp)
        self._grow(entry)

    def _grow(self, homeless: list) -> None:
        kept = [e for bucket in self.held for e in bucket] + [homeless]
        self.resizes += 1
        self.size = 0
        self._alloc(2 * (self.mask + 1))
        for key, payload in kept:
            self.insert(key, payload)

    def delete(self, key: bytes) -> bool:
        fp, h = self._mark(key)
        i = h & self.mask
        for b in (i, self._other(i, fp)):
            for k, entry in enumerate(self.held[b]):
                if self.fp[b][k] == fp and entry[0] == key:
                    del self.fp[b][k], self.held[b][k]
                    self.size -= 1
                    return True
        return False

    def items(self) -> Iterator[tuple[bytes, object]]:
        for bucket in self.held:
            for key, payload in bucket:
                yield key, payload


_PART = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def _fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = CuckooIndex()
    for b in batches:
        for key, doc, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            entry = index.get(key)
            if entry is None:
                index.insert(key, [doc, n])
            else:
                held = entry[1]
                if doc is not None and (held[0] is None or doc > held[0]):
                    held[0] = doc
                held[1] += n
    rows = list(index.items())
    for a in range(0, len(rows), 20_000):
        part = rows[a : a + 20_000]
        yield pa.record_batch([pa.array([k for k, _ in part], pa.binary()), pa.array([p[0] for _, p in part], pa.int64()), pa.array([p[1] for _, p in part], pa.int64())], schema=_PART)


def content_key(text="text"):
    """32 bytes of SHA-256 and the byte length; null text counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    return F.concat(F.unhex(F.sha2(t, 256)), F.unhex(F.lpad(F.hex(F.octet_length(t).cast("long")), 16, "0")))


def group_digests(keyed: DataFrame) -> DataFrame:
    """Rows (digest, doc_id, n) -> one row per digest: digest, keep_id (largest id), group_size."""
    schema = "digest binary, keep_id long, group_size long"
    part = keyed.mapInArrow(_fold, schema)
    return part.repartition(partitions(keyed.sparkSession), "digest").mapInArrow(_fold, schema)


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``.

    Texts are equal when identical; null counts as empty.  Of equal texts the row with the largest id stays.  Rows that
    repeat both id and text are one document and share ``kept``; a null id stays only where no row of its group has an id.
    Texts of any length are read whole.  An empty table gives an empty result; other columns are ignored.
    """
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), content_key(text).alias("digest"))
    groups = group_digests(keyed.select("digest", "doc_id", F.lit(1).cast("long").alias("n")))
    return keyed.join(groups, "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex(F.substring("digest", 1, 32))).alias("text_sha256"),
    )


def _maintain(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = CuckooIndex()
    gone: list[tuple[bytes, int]] = []
    for b in batches:
        for key, op, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if op < 0:
                gone.append((key, n))
            elif (entry := index.get(key)) is None:
                index.insert(key, n)
            else:
                entry[1] += n
    for key, n in gone:
        if (entry := index.get(key)) is not None:
            entry[1] -= n
            if entry[1] <= 0:
                index.delete(key)
    rows = list(index.items())
    yield pa.record_batch([pa.array([k for k, _ in rows], pa.binary()), pa.array([n for _, n in rows], pa.int64())], names=["digest", "n"])


def maintain(live: DataFrame, inserts: DataFrame, deletes: DataFrame) -> DataFrame:
    """Live digests (digest, n) after insertion and then deletion of rows (digest); a digest without rows goes."""
    one = F.lit(1).cast("long").alias("n")
    moves = live.select("digest", F.lit(1).alias("op"), F.col("n").cast("long")).unionByName(inserts.select("digest", F.lit(1).alias("op"), one)).unionByName(deletes.select("digest", F.lit(-1).alias("op"), one))
    moves = moves.where("digest is not null").groupBy("digest", "op").agg(F.sum("n").alias("n"))
    return moves.repartition(partitions(live.sparkSession), "digest").select("digest", "op", "n").mapInArrow(_maintain, "digest binary, n long")


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts; all columns stay, whatever their names.

    The row with the largest id stays; null counts as empty, and a row without an id stays only where no row of its group has
    one.  Rows go by id and text together, so a row that shares its id with a copy but not its text stays.  Of rows that
    repeat both, one stays.  Texts of any length are read whole; an empty table gives an empty result.
    """
    digest, who = fresh(docs, "digest"), fresh(docs, "who")
    name = lambda c: F.coalesce(c.cast("long").cast("string"), F.lit(""))
    keyed = docs.withColumns({digest: content_key(), who: name(docs["doc_id"])})
    groups = group_digests(keyed.select(F.col(digest).alias("digest"), F.col("doc_id").cast("long").alias("doc_id"), F.lit(1).cast("long").alias("n")))
    stays = groups.select(F.col("digest").alias(digest), name(F.col("keep_id")).alias(who))
    # rows meet by text and id, so that a text of a third of all rows spreads by its ids; one exchange serves both steps
    return keyed.join(stays.hint("shuffle_hash"), [digest, who], "left_semi").dropDuplicates([digest, who]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
FROM t WINDOW w AS (PARTITION BY text)
"""
