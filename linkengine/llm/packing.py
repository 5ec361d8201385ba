"""Bulk-synchronous best-fit packing of tokenised documents into sequences.

Pieces and gaps are rows of tables.  A step range-sorts both by size, learns global ranks from the row counts of the partitions
and deals the ranks out in shares of at most about ``SHARE`` rows, so that every share sees all sizes.  Each task sweeps its
share: pieces, longest first, look for their successor, the smallest gap that holds them; where more pieces than gaps meet, rank
resolves it (the k-th piece takes the k-th gap and those beyond sweep on to the next gap size); the gaps are updated and the
sweep goes on with the next length.  A share opens no more sequences than its tokens fill, so that what does not fit, pieces
and gaps, goes into the next step, in fewer shares, and meets there.  The last step has one share, or a step before it placed
less than half of its pieces; it opens what is still needed.  Steps are few, as each leaves at most half of the pieces.  Only
row counts of partitions and two figures a step reach the driver.
"""

from __future__ import annotations

import bisect
import gc
import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Store, partitions

CAPACITY = 2048
#: Rows of pieces and gaps that a task sweeps at once.
SHARE = 20_000
#: The id that ends each document.
END = 0
#: White-space slices in a worker's cache of ids; when it is full and between tasks it falls back to the ones met first,
#: which are the frequent ones.
CACHE, KEEP = 700_000, 450_000
#: Words whose ids are kept beside them, about, and texts that are cut at once.
WORDS_HELD, ROWS = 200_000, 1000


#: Slices whose words are found without the tokenizer's normaliser: printable ASCII and Latin-1 letters, which are composed and have
#: a lower case of one letter there.  The words are those of its pattern on such slices in lower case.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")
#: The normaliser and the splitting that these stand for, and the mark of a word's last id.
NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
LAST = "</w>"


class SliceTokenizer:
    """Ids of texts by a public tokenizer, slice by slice of ASCII white space, with a cache.

    The tokenizer lower-cases, drops white space before it merges and merges within a slice only, so the ids of a text are
    those of its slices in order; tests hold this against the tokenizer on whole texts.  New slices are encoded many at a
    time, with a mark between them that is one id and that no such slice holds.  Plain ones are put together from the ids of their
    words, and only new words are encoded, without normaliser; ids that end a word part them.
    """

    MARK = "\x01"
    GROUP = 200

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ids: dict[bytes, bytes] = {}
        mark = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.held: dict[str, bytes] = {}
        self.words, self.last = self._bare(Tokenizer)

    def _bare(self, kind: type) -> tuple:
        """(the tokenizer for words alone, which ids end a word); nothing where it is not made the way that PLAIN and WORDS know."""
        j = json.loads(self.tokenizer.to_str())
        steps = (j["pre_tokenizer"] or {}).get("pretokenizers", [])
        if j["normalizer"] != NORMALISER or len(steps) != 2 or steps[0] != SPLIT or steps[1]["type"] != "ByteLevel" or j["model"]["end_of_word_suffix"] != LAST or any("<|" not in t["content"] for t in j["added_tokens"]):
            return None, None
        vocab = j["model"]["vocab"]
        last = np.zeros(max(vocab.values()) + 1, bool)
        last[[i for t, i in vocab.items() if t.endswith(LAST)]] = True
        return kind.from_str(json.dumps(j | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, steps[1]]}})), last

    def by_words(self, new: list[bytes]) -> list[bytes]:
        """Ids of the plain ones of ``new``, from those of their words; the others are returned."""
        if len(self.held) > WORDS_HELD:
            self.held = {}
        rest, cut, held = [], [], self.held
        for s in new:
            t = s.decode("utf-8")
            if PLAIN.fullmatch(t) and "<|" not in t:
                cut.append((s, WORDS.findall(t.lower())))
            else:
                rest.append(s)
        fresh = list({w for _, words in cut for w in words if w not in held})
        for a in range(0, len(fresh), 50 * self.GROUP):
            groups = [fresh[i : i + self.GROUP] for i in range(a, min(a + 50 * self.GROUP, len(fresh)), self.GROUP)]
            for g, e in zip(groups, self.words.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                raw, at = ids.tobytes(), 0
                for w, end in zip(g, (np.flatnonzero(self.last[ids]) + 1).tolist(), strict=True):
                    held[w] = raw[4 * at : 4 * end]
                    at = end
        for s, words in cut:
            self.ids[s] = b"".join([held[w] for w in words])
        return rest

    def learn(self, new: list[bytes]) -> None:
        """Ids of slices that the cache has not."""
        if self.words is not None:
            new = self.by_words(new)
        alone = [s for s in new if self.mark is None or self.MARK.encode() in s]
        for s in alone:
            self.ids[s] = np.array(self.tokenizer.encode(s.decode("utf-8"), add_special_tokens=False).ids, "<u4").tobytes()
        if alone:
            new = [s for s in new if s not in self.ids]
        between = f" {self.MARK} "
        for a in range(0, len(new), 50 * self.GROUP):
            groups = [new[i : i + self.GROUP] for i in range(a, min(a + 50 * self.GROUP, len(new)), self.GROUP)]
            texts = [between.join([s.decode("utf-8") for s in g]) for g in groups]
            for g, e in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                raw = ids.tobytes()
                ends = np.append(np.flatnonzero(ids == self.mark), len(ids)).tolist()
                at = 0
                for s, end in zip(g, ends, strict=True):
                    self.ids[s] = raw[4 * at : 4 * end]
                    at = end + 1

    def trim(self) -> None:
        if len(self.ids) > KEEP:
            self.ids = dict(islice(self.ids.items(), KEEP))

    def batch(self, texts: list[bytes]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text, the end id last."""
        end = np.array([END], "<u4").tobytes()
        # capitals of ASCII texts go first, for fewer slices; elsewhere a mark may compose with the capital, and the names of
        # special tokens are matched as they stand, so those texts are left to the tokenizer
        own = pa.array([t.lower() if t.isascii() and b"<|" not in t else t for t in texts], pa.large_binary()).view(pa.large_string())
        cut = pc.ascii_split_whitespace(own)  # slices at the ends of a text may be empty
        if len(self.ids) > CACHE:
            self.trim()
        self.ids[b""] = b""
        codes = cut.flatten().dictionary_encode()  # the cache is asked once for each distinct slice
        slices = codes.dictionary.view(pa.large_binary()).to_pylist()
        self.learn([s for s in slices if s not in self.ids])
        ids = [self.ids[s] for s in slices]
        ends = np.append(0, np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4))
        found = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<u4"))).take(codes.indices)
        at = 4 * found.offsets.to_numpy()[cut.offsets.to_numpy()]
        whole = found.values.to_numpy().tobytes()
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield whole[lo:hi] + end


@lru_cache(1)
def _tokenizer(path: str) -> SliceTokenizer:
    return SliceTokenizer(path)


def _pieces(path: str, capacity: int, keep_ids: bool):
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(path)
        for b in batches:
            docs = b.column(0).to_pylist()
            texts = b.column(1).cast(pa.large_binary())
            for a in range(0, b.num_rows, ROWS):
                part = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in texts[a : a + ROWS]]
                rows = []
                for doc, ids in zip(docs[a : a + ROWS], tok.batch(part), strict=True):
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        rows.append((doc, k, at // 4, len(own) // 4, zlib.crc32(own), own))
                doc, k, at, n, crc, raw = zip(*rows, strict=True)
                out = [pa.array(doc, pa.int64()), pa.array(k, pa.int32()), *(pa.array(x, pa.int64()) for x in (at, n, crc))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(np.frombuffer(b"".join(raw), "<u4").astype(np.int32))))
                    names.append("ids")
                yield pa.record_batch(out, names=names)
        tok.trim()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # nothing here is cyclic, and the collector would walk the caches again and again
        try:
            yield from cut(batches)
        finally:
            gc.enable()

    return run


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenise(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(_pieces(path, capacity, keep_ids), _PIECE + (", ids array<int>" if keep_ids else ""))


def sweep(lengths: np.ndarray, seqs: np.ndarray, gaps: np.ndarray, capacity: int, limit: int | None, first: int) -> tuple[np.ndarray, np.ndarray, dict[int, list[np.ndarray]]]:
    """Best fit of falling ``lengths`` into the sequences ``seqs`` with ``gaps`` and at most ``limit`` new ones from ``first`` on.

    Returns the sequence (-1 where nothing fits) and the offset of each piece and the sequences by what gap they have left.
    """
    held: dict[int, list[np.ndarray]] = {}
    sizes: list[int] = []  # the gaps that have sequences, ascending
    seq, off = np.full(len(lengths), -1, np.int64), np.full(len(lengths), -1, np.int64)
    opened = 0

    def leave(gap: int, ids: np.ndarray) -> None:
        if gap and len(ids):
            if gap not in held:
                held[gap] = []
                bisect.insort(sizes, gap)
            held[gap].append(ids)

    order = np.lexsort((seqs, gaps))
    for g in np.unique(gaps).tolist():
        leave(g, seqs[order][gaps[order] == g])
    heads = np.flatnonzero(np.append(True, lengths[1:] != lengths[:-1])) if len(lengths) else np.zeros(0, np.int64)
    for at, stop in zip(heads.tolist(), [*heads[1:].tolist(), len(lengths)], strict=True):
        length = int(lengths[at])
        while at < stop:
            i = bisect.bisect_left(sizes, length)
            if i < len(sizes):
                gap = sizes[i]
                ids = held[gap].pop()
                if not held[gap]:
                    del held[gap], sizes[i]
                n = min(len(ids), stop - at)
                leave(gap, ids[n:])
                seq[at : at + n], off[at : at + n] = ids[:n], capacity - gap
                leave(gap - length, ids[:n])
                at += n
            elif limit is None or opened < limit:  # new sequences, each with as many pieces of this length as fit
                slots = min(capacity // length, stop - at)
                n = (stop - at) // slots if limit is None else min((stop - at) // slots, limit - opened)
                ids = first + opened + np.arange(n)
                seq[at : at + n * slots] = np.tile(ids, slots)
                off[at : at + n * slots] = np.repeat(np.arange(slots) * length, n)
                opened += n
                leave(capacity - slots * length, ids)
                at += n * slots
            else:
                break
    return seq, off, held


def _shares(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The whole shares of a partition sorted by its last column."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        share = b.column(b.num_columns - 1).to_numpy()
        cuts = [0, *(np.flatnonzero(share[1:] != share[:-1]) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[-1].column(b.num_columns - 1)[0].as_py() != share[lo]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _swept(step: int, capacity: int, last: bool):
    """Rows with sequence_id and offset, null where nothing fits, and rows of the gaps that are left (null doc_id, gap true)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _shares(batches):
            share = t.column("share")[0].as_py()
            t = t.drop_columns(["share"]).combine_chunks()
            is_gap = t.column("gap").to_numpy(zero_copy_only=False)
            size = t.column("length").to_numpy()
            own = np.flatnonzero(~is_gap)
            ids = [t.column(c).take(pa.array(own)).to_pandas().fillna(-1).to_numpy() for c in ("doc_id", "piece")]
            own = own[np.lexsort((ids[1], ids[0], -size[own]))]
            seqs, gaps = t.column("sequence_id").take(pa.array(np.flatnonzero(is_gap))).to_numpy().astype(np.int64), size[is_gap]
            limit = None if last else max(0, int(size[own].sum() - gaps.sum()) // capacity)
            seq, off, held = sweep(size[own], seqs, gaps, capacity, limit, step << 58 | share << 30)
            rows = t.take(pa.array(own))
            for name, v in (("sequence_id", seq), ("offset", off)):
                rows = rows.set_column(rows.schema.get_field_index(name), name, pa.array(v, pa.int64(), mask=seq < 0))
            yield from rows.to_batches()
            if held and not last:
                left = pa.array(np.concatenate([np.full(sum(map(len, ids)), g) for g, ids in held.items()]), pa.int64())
                cols = {"length": left, "sequence_id": pa.array(np.concatenate([x for ids in held.values() for x in ids]), pa.int64()), "gap": pa.array(np.ones(len(left), bool))}
                yield pa.record_batch([cols.get(f.name, pa.nulls(len(left), f.type)) for f in rows.schema], schema=rows.schema)

    return run


def _dealt(bases: dict[int, int], shares: int):
    """Rows with the share of their global rank in place of their mark."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mark = b.column(b.num_columns - 1).to_numpy()
            rank = np.array([bases[p] for p in (mark >> 33).tolist()], np.int64) + (mark & ((1 << 33) - 1))
            yield pa.record_batch([*b.columns[:-1], pa.array(rank % shares)], names=[*b.schema.names[:-1], "share"])

    return run


def _step(rows: DataFrame, store: Store, step: int, capacity: int, stalled: bool) -> tuple[DataFrame, bool]:
    """(rows after a step, whether it was the last) of pieces and gaps."""
    n = partitions(rows.sparkSession)
    order = [F.desc("length"), F.asc("gap"), F.asc("doc_id"), F.asc("piece"), F.asc("sequence_id")]
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranged = store.save(ranged.withColumn("mark", F.monotonically_increasing_id()), "ranged")
    counts = ranged.groupBy(F.shiftright("mark", 33).alias("part")).count().collect()  # a row for each partition
    bases, total = {}, 0
    for part, count in sorted((r["part"], r["count"]) for r in counts):
        bases[part] = total
        total += count
    shares = -(-total // SHARE) if total else 1
    last = stalled or shares == 1
    dealt = ranged.mapInArrow(_dealt(bases, shares), ranged.drop("mark").withColumn("share", F.lit(0).cast("long")).schema)
    dealt = dealt.repartition(min(shares, n), "share").sortWithinPartitions("share")
    out = store.save(dealt.mapInArrow(_swept(step, capacity, last), ranged.drop("mark").schema), "swept")
    return out, last


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows of ``pieces`` with sequence_id and offset: within a sequence the offsets are gapless from 0.

    ``length`` must lie in 1..capacity.  An empty table gives an empty result.
    """
    store = Store(pieces.sparkSession, "packing")
    rows = pieces.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long"), "gap": F.lit(False)})
    done, stalled, step = None, False, 0
    while True:
        out, last = _step(rows, store, step, capacity, stalled)
        placed = out.where("not gap and sequence_id is not null").drop("gap")
        done = placed if done is None else done.unionByName(placed)
        if last:
            return done
        open_ = out.where("not gap and sequence_id is null")
        left, least, before = *open_.agg(F.count("*"), F.min("length")).first(), out.where("not gap").count()
        if not left:
            return done
        stalled = 2 * left > before
        rows = open_.unionByName(out.where(f"gap and length >= {least}"))
        step += 1


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces of the documents and their places; see :func:`tokenise` and :func:`pack`.

    A null or empty text packs its end id alone; a text of any length is cut into pieces of ``capacity`` ids.  Rows that
    repeat an id or a text are packed apart, each with its own pieces; a null id is packed like any other.  Pieces of one
    length are ranked by id and piece.  An empty table gives an empty result; extra columns are ignored.
    """
    pieces = Store(docs.sparkSession, "pieces").save(tokenise(docs, path, capacity, keep_ids), "pieces")
    return pack(pieces, capacity)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
