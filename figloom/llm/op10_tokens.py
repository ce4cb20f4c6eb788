"""Token files: Parquet lists of ids in ascending document order.

Documents are range-partitioned and sorted by id, encoded partition by
partition, and written with a dictionary (or delta) encoding, bounded row groups and
pages, and Parquet's page index, so that a reader of a few documents, or of
metadata only, touches few pages.  Each file row also holds where it lies in
its part; the parts' totals (one row per file) give the global start.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, new_path, whole_text
from .fast_tokens import encoder

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
#: Bytes of a row group and a page, and rows of a page.
ROW_GROUP, PAGE, PAGE_ROWS = 32 << 20, 256 << 10, 5_000
#: Texts taken at once by the encoder, in bytes of Arrow data.
STEP_BYTES = 1 << 20


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def steps(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about STEP_BYTES of the text column (one row at least)."""
    size = np.cumsum(np.diff(text_offsets(batch.column(column))))
    at = 0
    while at < batch.num_rows:
        done = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, done + STEP_BYTES, side="right")))
        yield batch.slice(at, to - at)
        at = to


def text_offsets(a: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type) else np.int32
    return np.frombuffer(a.buffers()[1], kind)[a.offset : a.offset + len(a) + 1].astype(np.int64)


def token_rows(df: DataFrame, vocab: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Encode the rows of each partition in their order: the other columns, ``ids``, ``part``, ``local_start``."""
    keep = [c for c in df.columns if c != "_text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, at = encoder(vocabulary(vocab)), TaskContext.get().partitionId(), 0
        for whole in batches:
            for b in steps(whole, "_text") if whole.num_rows else ():
                ids, counts = enc.encode(b.column("_text").to_pylist())
                ends = np.cumsum(counts + 1)
                flat = np.insert(ids, np.cumsum(counts), end_id).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))
                starts = at + ends - (counts + 1)
                at += int(ends[-1])
                cols = [b.column(c) for c in keep]
                cols += [lists, pa.array(np.full(len(ends), part, np.int32)), pa.array(starts)]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, "ids", "part", "local_start"])

    return df.mapInArrow(run, f"{schema}, ids array<int>, part int, local_start bigint")


def write_tokens(
    df: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocab: str = VOCABULARY,
    end_id: int = END_ID,
    encoding: str = "dictionary",
    row_group: int = ROW_GROUP,
    page: int = PAGE,
    page_rows: int = PAGE_ROWS,
) -> None:
    """Write ``df`` as token files in ascending order of id (null ids first, ties by text).

    A null text counts as empty: its list holds the end id alone.  Repeated
    rows are written each.  An empty table gives files without rows.  ``encoding`` is
    ``dictionary`` or ``delta``.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("_text"))
    sorted_rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first())
    sorted_rows = sorted_rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_text")
    out = token_rows(sorted_rows, vocab, end_id).withColumn("n_tokens", F.size("ids").cast("long"))
    delta = encoding == "delta"
    options = {
        "parquet.enable.dictionary": str(not delta).lower(),
        "parquet.writer.version": "v2" if delta else "v1",
        "parquet.block.size": str(row_group),
        "parquet.page.size": str(page),
        "parquet.page.row.count.limit": str(page_rows),
        "compression": "zstd",
    }
    out.write.options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The token files with the global ``start``; reading no ``ids`` touches the metadata's pages only."""
    rows = spark.read.parquet(path)
    by_part = rows.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    # one row per file
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("part", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_base"))
    out = rows.join(F.broadcast(base), "part").withColumn("start", F.col("_base") + F.col("local_start"))
    return out.select(*(columns or ["doc_id", "start", "n_tokens", "ids"]))


def token_digest(df: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` of the rows that ``read_tokens`` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            values = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            offsets = lists.offsets.to_numpy().tolist()
            crc = [zlib.crc32(values[x:y]) for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
            count = np.diff(np.array(offsets, np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("start"), pa.array(count), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return df.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_tokens(documents(spark, sf_dir), path)
    return token_digest(read_tokens(spark, path))


QUERIES = {"op10_token_files": op10_token_files}
ORACLE_SQL: dict[str, str] = {}
