"""Writers: JSON lines, CSV, keyed inserts, ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_csv(df: DataFrame, path: str, fields: Sequence[str]) -> None:
    """The fields in their order; missing columns and values are empty."""
    cols = [F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) if f in df.columns else F.lit("").alias(f) for f in fields]
    df.select(*cols).write.mode("overwrite").options(header=True, emptyValue="").csv(path)


def append_ledger(df: DataFrame, path: str, key: str, reason: str | None = None) -> None:
    """Lines of key, or key TAB reason."""
    line = F.concat_ws("\t", key, reason) if reason else F.col(key).cast("string")
    df.select(line.alias("value")).write.mode("append").text(path)
