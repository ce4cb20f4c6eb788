"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor
kept, and returns a DataFrame; all but the last return the columns of docs.

1. toxicity: documents that the factorization machine rejects go (score 0.5 or more).
2. exact dedup: of equal texts the largest id stays, as in op5.
3. near-dedup: of documents whose 5-word shingles have a Jaccard similarity of 0.8 or more
   (directly or over others) the smallest id stays.  Candidates come from an exact prefix filter,
   not from SimHash, which loses pairs at that similarity.  Rows that share an id are one document here.
4. decontamination: documents in which a benchmark item is found go.
5. packing: one row per piece of a document, as in op9.

Null texts count as empty.  A null id is an id of its own: it loses to others
in stages 2 and 3 and is kept where it stands alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figloom.llm.common import NULL_ID, discard, documents, materialise, unused, whole_text
from figloom.llm.near_copies import near_components
from figloom.llm.op3_decontaminate import decontaminate
from figloom.llm.op5_exact import exact_dedup
from figloom.llm.op8_toxicity import scored
from figloom.llm.op9_packing import pack


#: So many ids (8 bytes each) are broadcast; beyond, the join is by shuffle.
BROADCAST_IDS = 500_000


def _keyed(docs: DataFrame) -> DataFrame:
    """Whole rows as ``row``, which no other name can clash with, and their ids as ``id``."""
    return docs.select(F.struct("*").alias("row"), F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that score under 0.5, with their columns as they are, whatever their names.

    Null and empty texts score by the machine's bias; repeated rows stay or go alike; an empty table gives no rows.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    text, score = unused(docs, "_row_text"), unused(docs, "_row_score")
    kept = scored(docs.withColumn(text, whole_text()), labels, score, text_col=text).filter(F.col(score) < 0.5)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts (null: empty) one with the largest id; a null id loses to all others.

    Of rows repeated in id and text one stays, the one whose JSON has the least SHA-256.  An empty table gives no rows.
    """
    kept = exact_dedup(docs, keep="max").filter("kept").select(
        F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), F.unhex("text_sha256").alias("sha")
    )
    keyed = _keyed(docs).withColumn("sha", F.unhex(F.sha2(F.coalesce("row.text", F.lit("")), 256)))
    stay = keyed.join(kept, ["id", "sha"], "left_semi").groupBy("id", "sha")
    return stay.agg(F.min_by("row", F.sha2(F.to_json("row"), 256)).alias("row")).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near documents the row with the smallest id (null ids rank last: one of them stays where no other is).

    Repeated rows of the id that stays all stay.  Texts without words are equal.  An empty table gives no rows.
    """
    found = near_components(docs).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    gone = materialise(found.groupBy("id").agg(F.max("kept").alias("kept")).filter("not kept").select("id"), "near-copies")
    few = gone.count() <= BROADCAST_IDS  # then the rows that stay need not move
    return _keyed(docs).join(F.broadcast(gone) if few else gone.hint("shuffle_hash"), "id", "left_anti").select("row.*")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows in which no benchmark item is found; null and empty texts stay, repeated rows stay or go alike."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of each row's tokens; null texts are empty, rows with null or repeated ids are packed each."""
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack_sequences),
]

#: Learned scores, fingerprints and a tokenizer are beyond SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's table is deleted when the next one is written (the last one's when the application ends)."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES[:-1]):
        kept = materialise(stage(spark, docs, sf_dir), name)
        if k:
            discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
