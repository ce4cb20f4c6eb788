"""Line deduplication over documents.

1. Each long line becomes a row of its key's 128-bit hash, its document and its position.
2. The rows are range-partitioned by hash and by block of documents, so that a line in
   very many documents lies in many pieces, with a secondary sort by document and position.
   Each piece is streamed: a row whose document differs from the one before is the
   key's first occurrence in that document, and the piece's first row has its best document.
3. The first occurrences, adjacent now, are added up per key (a piece gives one partial row):
   documents that hold it and the document that keeps it.
4. Streamed rows of keys of enough documents, but for the keeper's, are dropped lines.
   They return as one run-length keep bitmap per document, not as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ASCII_SPACE, NULL_ID, ascii_lower, documents, materialise, whole_text

MIN_CHARS = 40
MIN_DOCS = 5
#: A key's occurrences are split in pieces of at most so many documents.
PIECE = 4_096
#: So many keys (about 32 bytes each) are broadcast; beyond, the join is by shuffle.
BROADCAST_KEYS = 100_000


def _line_keys(text: Column, min_chars: int) -> Column:
    """Per line the MD5 of its key, or null if the key is short."""

    def key(line: Column) -> Column:
        bare = F.btrim(line, F.lit(ASCII_SPACE))
        return F.when(F.length(bare) >= min_chars, F.md5(ascii_lower(bare)))

    return F.transform(F.split(text, "\n", -1), key)


def keep_runs(drops: Column) -> Column:
    """The keep bitmap as the line numbers where it flips, kept lines first: [from, to) of each dropped run, from sorted positions."""
    starts = F.filter(drops, lambda p, i: (i == 0) | (F.get(drops, i - 1) < p - 1))
    ends = F.filter(drops, lambda p, i: (i == F.size(drops) - 1) | (F.get(drops, i + 1) > p + 1))
    return F.flatten(F.zip_with(starts, ends, lambda a, b: F.array(a, b + 1)))


def dropped(runs: Column) -> Column:
    """How many lines a bitmap drops."""
    signed = F.transform(runs, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    return F.aggregate(signed, F.lit(0), lambda a, x: a + x)


def line_rows(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(_k, _id, _h, _row, _pos) of each long line; ``_row`` numbers the input rows."""
    rows = df.select(F.coalesce(F.col(id_col), F.lit(NULL_ID)).cast("long").alias("_id"), whole_text(text_col).alias("_t"))
    rows = rows.select(
        "_id", F.xxhash64("_t").alias("_h"), F.monotonically_increasing_id().alias("_row"), _line_keys(F.col("_t"), min_chars).alias("_keys")
    )
    found = rows.select("_id", "_h", "_row", F.posexplode("_keys").alias("_pos", "_hex")).filter("_hex is not null")
    return found.select(F.unhex("_hex").alias("_k"), "_id", "_h", "_row", "_pos")


def line_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    keep: str = "min",
    piece: int = PIECE,
    broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    """One row per distinct (id, text hash) that loses lines: ``_id``, ``_h``, ``keep_runs`` (see there).

    A line's key is the line stripped of ASCII white space with A-Z lowered.
    Keys of at least ``min_chars`` code points in at least ``min_docs`` rows
    keep their lines only in the smallest (``keep='max'``: largest) id.  A null
    text is one empty line.  A null id ranks below all others.  Repeated rows
    count as documents of their own; those with the keeping id all keep.
    """
    largest = keep == "max"
    # written once: choosing range splitters reads its input a second time
    found = materialise(line_rows(df, id_col, text_col, min_chars), "line-rows")
    order = F.col("_id").desc() if largest else F.col("_id").asc()
    stream = Window.partitionBy("_k", "_block").orderBy(order, "_row", "_pos")
    streamed = (
        found.withColumn("_block", F.expr(f"_row div {piece}"))
        .repartitionByRange("_k", "_block")
        .withColumn("_new", ~F.lag("_row").over(stream).eqNullSafe(F.col("_row")))
        .withColumn("_best", F.first("_id").over(stream))
        .select("_k", "_id", "_h", "_pos", "_new", "_best")
    )
    streamed = materialise(streamed, "line-stream")
    firsts = streamed.filter("_new").groupBy("_k")
    heavy = firsts.agg(F.count(F.lit(1)).alias("_n"), (F.max if largest else F.min)("_best").alias("_keeper"))
    heavy = materialise(heavy.filter(F.col("_n") >= min_docs).select("_k", "_keeper"), "lines")
    small = heavy.count() <= broadcast_keys
    lost = streamed.join(F.broadcast(heavy) if small else heavy, "_k").filter("_id <> _keeper")
    drops = lost.groupBy("_id", "_h").agg(F.array_sort(F.collect_set("_pos")).alias("_drops"))
    return drops.select("_id", "_h", keep_runs(F.col("_drops")).alias("keep_runs"))


def apply_bitmap(lines: Column, runs: Column) -> Column:
    """The kept ones of ``lines`` joined by line feeds.  Both are columns, not expressions, so that they are worked out once."""

    def kept(i: Column) -> Column:
        start = F.coalesce(F.get(runs, 2 * i - 1), F.lit(0))
        stop = F.coalesce(F.get(runs, 2 * i), F.size(lines))
        return F.slice(lines, start + 1, stop - start)

    spans = F.transform(F.sequence(F.lit(0), (F.size(runs) / 2).cast("int")), kept)
    return F.array_join(F.flatten(spans), "\n")


def line_dedup_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: id, ``n_lines``, ``n_dropped``, ``kept_sha256`` and the bitmap ``keep_runs`` (null: all kept).

    Nulls, ties, repeated rows: see ``line_dedup``.  An empty table gives no rows; other columns are ignored.
    """
    marks = line_dedup(df, id_col, text_col, **options)
    rows = df.select(
        F.col(id_col).alias("_own"),
        whole_text(text_col).alias("_t"),
        F.coalesce(F.col(id_col), F.lit(NULL_ID)).cast("long").alias("_id"),
    ).withColumn("_h", F.xxhash64("_t"))
    out = rows.join(marks.hint("shuffle_hash"), ["_id", "_h"], "left").withColumn("_lines", F.split("_t", "\n", -1))
    kept = F.when(F.col("keep_runs").isNull(), F.col("_t")).otherwise(apply_bitmap(F.col("_lines"), F.col("keep_runs")))
    return out.select(
        F.col("_own").alias(id_col),
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(dropped(F.col("keep_runs")), F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(kept, 256).alias("kept_sha256"),
        "keep_runs",
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup_digest(documents(spark, sf_dir), keep="max").drop("keep_runs")


QUERIES = {"op6_line_dedup": op6_line_dedup}

ORACLE_SQL = {
    "op6_line_dedup": r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), h AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT k.*, (h.key IS NOT NULL AND k.doc_id <> h.keeper) AS gone FROM k LEFT JOIN h ON k.key = h.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
}
