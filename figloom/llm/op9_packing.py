"""Sum-of-squares packing of token sequences.

Documents are encoded and cut where they lie; each partition packs its own
pieces, longest first, so no text or id moves.  A piece goes where the sum of
squared counts of open bins per residual gap becomes smallest.  What a
partition leaves open is then packed once more: bins that stayed partly empty
travel as one unit (their pieces' lengths only) to fewer and larger groups.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialise, whole_text
from .fast_tokens import encoder
from .op10_tokens import steps, vocabulary

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
CAPACITY = 4096


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each size (1..capacity), placed in the given order.

    Placing a size s in a bin of gap g lowers the count N(g) and raises N(g - s);
    full bins count nothing.  The choice is the least sum of N(h)^2, ties to the smaller gap.
    """
    count = np.zeros(capacity + 1, np.int64)  # open bins per gap
    cost = np.ones(capacity + 1, np.int64)  # what one more bin of this gap adds
    cost[0] = 0
    open_bins: dict[int, list[int]] = defaultdict(list)
    where, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    bins = 0
    never = np.iinfo(np.int64).max // 4
    leave = np.full(capacity + 1, never, np.int64)  # what taking a bin of this gap adds
    for i, s in enumerate(sizes.tolist()):
        fits = leave[s:] + cost[: capacity + 1 - s]
        k = int(np.argmin(fits))
        new = int(cost[capacity - s]) if s < capacity else 0
        if fits[k] <= new:
            g = s + k
            b = open_bins[g].pop()
            count[g] -= 1
            leave[g] = 1 - 2 * count[g] if count[g] else never
            cost[g] = 2 * count[g] + 1
        else:
            g, b = capacity, bins
            bins += 1
        where[i], offset[i] = b, capacity - g
        rest = g - s
        if rest:
            count[rest] += 1
            leave[rest] = 1 - 2 * count[rest]
            cost[rest] = 2 * count[rest] + 1
            open_bins[rest].append(b)
    return where, offset


PIECES = (
    "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, "
    "bin bigint, offset bigint, fill bigint"
)


def _pack(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset and the bin's fill of each size, placed longest first."""
    order = np.argsort(-sizes, kind="stable")
    where, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    where[order], offset[order] = sum_of_squares(sizes[order], capacity)
    fill = np.bincount(where, weights=sizes).astype(np.int64) if len(sizes) else np.empty(0, np.int64)
    return where, offset, fill[where]


def cut_and_pack(df: DataFrame, vocab: str, end_id: int, capacity: int) -> DataFrame:
    """Encode, cut and pack each partition of (doc_id, _text); the bin numbers hold the partition's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = encoder(vocabulary(vocab)), TaskContext.get().partitionId()
        found: list[list[np.ndarray]] = []
        for whole in batches:
            for b in steps(whole, "_text") if whole.num_rows else ():
                ids, counts = enc.encode(b.column("_text").to_pylist())
                flat = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
                lengths = counts + 1
                pieces = -(-lengths // capacity)
                piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                size = np.minimum(np.repeat(lengths, pieces) - piece * capacity, capacity)
                at = np.repeat(np.cumsum(lengths) - lengths, pieces) + piece * capacity
                crc = [zlib.crc32(flat[x : x + n]) for x, n in zip(at.tolist(), size.tolist(), strict=True)]
                ids_of = b.column("doc_id")
                rows = ids_of.take(pa.array(np.repeat(np.arange(b.num_rows), pieces)))
                found.append([rows, piece, piece * capacity, size, np.array(crc, np.int64)])
        if not found:
            return
        size = np.concatenate([x[3] for x in found])
        where, offset, fill = _pack(size, capacity)
        where += part << 32
        done = 0
        for doc, piece, start, n, crc in found:
            to = done + len(n)
            cols = [doc, pa.array(piece.astype(np.int32)), *map(pa.array, (start, n, crc, where[done:to], offset[done:to], fill[done:to]))]
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in PIECES.split(", ")])
            done = to

    return df.mapInArrow(run, PIECES)


def repack_open(pieces: DataFrame, capacity: int, group: int = 256) -> DataFrame:
    """Pack bins that are not full again, as units, over ``group`` partitions at once: ``bin``, ``new_bin``, ``base``."""
    units = pieces.filter(F.col("fill") < capacity).groupBy("bin").agg(F.first("fill").alias("fill"))
    units = units.withColumn("_g", F.floor(F.shiftright("bin", 32) / group))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("bin")
        where, offset, _ = _pack(t.column("fill").to_numpy(), capacity)
        first = np.full(where.max() + 1, -1, np.int64)
        name = t.column("bin").to_numpy()
        first[where[::-1]] = name[::-1]  # a new bin takes the number of its first unit
        return pa.table({"bin": t.column("bin"), "new_bin": first[where], "base": offset})

    return units.groupBy("_g").applyInArrow(run, "bin bigint, new_bin bigint, base bigint")


def pack(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocab: str = VOCABULARY,
    end_id: int = END_ID,
    capacity: int = CAPACITY,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty (the end id alone).  A null id stays null.
    Repeated rows are packed each.  Documents longer than ``capacity`` are cut
    in pieces of that length, no others.  An empty table gives no rows.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("_text"))
    pieces = materialise(cut_and_pack(rows, vocab, end_id, capacity), "pieces")
    moved = pieces.join(repack_open(pieces, capacity), "bin", "left")
    return moved.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        F.coalesce("new_bin", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"),
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


QUERIES = {"op9_packing": op9_packing}
ORACLE_SQL: dict[str, str] = {}
