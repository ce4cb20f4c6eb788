"""Exact deduplication by content sort.

1. Rows are range-partitioned by the text's first characters (with a tie hash for texts
   that share them), between splitters that Spark samples; a splitter is bounded, so the
   driver never gathers whole texts.
2. Each partition is sorted by the whole text (external sort), which places equals
   adjacent, and neighbours are compared in full.  A run of equal texts starts where a text
   differs from its neighbour; its first row has the identifier that stays.
   Hashes only place rows: texts whose hashes agree are still told apart.
3. A text of very many copies is cut in pieces of about ``piece`` rows, known by a count per
   hash (the BROADCAST_ROWS commonest ones: any other has few of all rows).  Each piece sends its first row, and those rows are compared in full again over the pieces.

A text moves once.  Rows of other texts need no second exchange.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialise

#: Characters of a splitter, and rows of a piece.
HEAD, PIECE = 256, 1_000
#: Texts that are cut at most, and so many small rows are broadcast; beyond, a join is by shuffle.
BROADCAST_ROWS = 100_000


def exact_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    normalise: Callable[[Column], Column] | None = None,
    salts: int = 2,
    piece: int = PIECE,
    head: int = HEAD,
    tie: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """One row per input row: its id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    ``keep`` is ``min`` or ``max``: which id of a group stays.  A null text
    counts as empty.  A null id stays only if its group has no other id, and
    then ``keep_id`` is null.  Of repeated rows with the kept id exactly one is
    kept.  An empty table gives no rows; other columns are ignored.  Groups of
    over ``piece`` rows are cut in ``salts`` pieces at least.
    """
    largest = keep == "max"
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).alias("_id"), (normalise(text) if normalise else text).alias("_t"))
    rows = rows.withColumns({"_head": F.substring("_t", 1, head), "_tie": tie(F.col("_t"))})

    hot = rows.groupBy(F.col("_tie").alias("_h")).agg(F.count(F.lit(1)).alias("_copies")).filter(F.col("_copies") > piece)
    hot = materialise(hot.orderBy(F.desc("_copies"), "_h").limit(BROADCAST_ROWS), "hot-texts")
    rows = rows.join(F.broadcast(hot), F.col("_tie") == F.col("_h"), "left")
    pieces = F.greatest(F.lit(salts), F.expr(f"_copies div {piece} + 1"))
    rows = rows.withColumn("_p", F.when(F.col("_copies").isNull(), 0).otherwise(F.pmod(F.xxhash64("_id"), pieces)))

    order = F.col("_id").desc_nulls_last() if largest else F.col("_id").asc_nulls_last()
    place = ["_head", "_tie", "_p"]
    stream = Window.partitionBy(*place).orderBy("_t", order)
    so_far = stream.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def of_first(c: Column) -> Column:
        return F.last(F.when(F.col("_new"), c), ignorenulls=True).over(so_far)

    cells = (
        rows.repartitionByRange(*place)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_new", ~F.lag("_t").over(stream).eqNullSafe(F.col("_t")))
        .withColumns({"_run": of_first(F.col("_at")), "_keep": of_first(F.struct("_id"))["_id"]})
        .withColumn("_first", F.when(F.col("_new") & F.col("_copies").isNotNull(), F.col("_t")))
        .withColumn("_sha", F.unhex(F.sha2("_t", 256)))
        .drop("_t")
        .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*place, "_run")))
        .select("_id", "_tie", "_run", "_new", "_keep", "_n", "_sha", "_first")
    )
    cells = materialise(cells, "exact")

    # the first rows of hot texts' pieces: a bounded share (one in ``piece``) of the rows
    same = Window.partitionBy("_tie", "_first")
    firsts = cells.filter("_first is not null").select(
        F.col("_run").alias("_r"),
        (F.max if largest else F.min)("_keep").over(same).alias("_best"),
        F.sum("_n").over(same).alias("_size"),
        (F.row_number().over(same.orderBy(F.col("_keep").desc_nulls_last() if largest else F.col("_keep").asc_nulls_last(), "_run")) == 1).alias("_stays"),
    )
    firsts = materialise(firsts, "hot-pieces")
    joined = cells.join(F.broadcast(firsts) if firsts.count() <= BROADCAST_ROWS else firsts, F.col("_run") == F.col("_r"), "left")
    in_pieces = F.col("_r").isNotNull()
    return joined.select(
        F.col("_id").alias(id_col),
        F.when(in_pieces, F.col("_best")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_size", "_n").cast("long").alias("group_size"),
        (F.col("_new") & F.coalesce("_stays", F.lit(True))).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir), keep="max")


QUERIES = {"op5_exact_dedup": op5_exact_dedup}

ORACLE_SQL = {
    "op5_exact_dedup": """
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
}
