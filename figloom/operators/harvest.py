"""Keyed ingestion of literature-like records: projection, enrichment, merging, ledgers, outcomes."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .encode import same

ITEM = (
    "DOI string, title array<string>, `container-title` array<string>, "
    "issued struct<`date-parts`: array<array<int>>>, URL string, abstract string, "
    "author array<struct<given: string, family: string, name: string>>"
)
ENRICHMENT = "doi string, pmcid string, pmid string, abstractText string, isOpenAccess string, authorString string"
FIELDS = ("doi", "title", "journal", "year", "url", "pmcid", "pmc_url", "pmid", "is_open_access", "abstract", "authors")
OUTCOMES = ("ok", "no-source-data", "no-figures", "fetch-error")
NO_YEAR = -1_000_000_000


def project(items: DataFrame) -> DataFrame:
    """Search items as records, before enrichment."""
    return items.select(
        F.trim(F.col("DOI")).alias("doi"),
        F.coalesce(F.get("title", F.lit(0)), F.lit("")).alias("title"),
        F.coalesce(F.get(F.col("container-title"), F.lit(0)), F.lit("")).alias("journal"),
        F.get(F.get(F.col("issued.date-parts"), F.lit(0)), F.lit(0)).alias("year"),
        F.col("URL").alias("url"),
        F.col("abstract").alias("_abstract"),
        X.authors(F.col("author")).alias("_authors"),
    )


def doi_key(c: Column | str = "doi") -> Column:
    return F.lower(F.trim(F.col(c) if isinstance(c, str) else c))


def enrich(records: DataFrame, extra: DataFrame, pmc_prefix: str = "") -> DataFrame:
    """Left join on the key; no match gives nulls and closed access.  Of several matches the least row (by its columns in order) counts."""
    e = extra.withColumn("_key", doi_key()).drop("doi")
    e = e.groupBy("_key").agg(F.min(F.struct(*[c for c in e.columns if c != "_key"])).alias("_e")).select("_key", "_e.*")
    out = records.withColumn("_key", doi_key()).join(e, "_key", "left")
    return out.select(
        "doi", "title", "journal", "year", "url", "pmcid",
        F.when(F.nullif(F.col("pmcid"), F.lit("")).isNotNull(), F.concat(F.lit(pmc_prefix), F.col("pmcid"))).alias("pmc_url"),
        "pmid",
        F.coalesce(F.upper("isOpenAccess").isin("Y", "TRUE", "1"), F.lit(False)).alias("is_open_access"),
        X.first_text(F.col("abstractText"), F.col("_abstract")).alias("abstract"),
        X.first_text(F.col("authorString"), F.col("_authors")).alias("authors"),
    )


def in_family(container: Column, names: Sequence[str], prefixes: Sequence[str]) -> Column:
    """Whether a container title is one of the names or starts with one of the prefixes (any case)."""

    def fits(t: Column) -> Column:
        low = F.lower(F.trim(t))
        hit = low.isin([n.lower() for n in names])
        for p in prefixes:
            hit = hit | low.startswith(p.lower())
        return hit

    return F.coalesce(F.exists(container, fits), F.lit(False))


def merge_first(existing: DataFrame, new: DataFrame, key: Column, order: str, drop_unkeyed: bool = True) -> DataFrame:
    """Union in which the first row of a key stays: existing rows before new ones, then by ``order``."""
    both = existing.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    both = both.withColumn("_key", key)
    known = F.nullif(F.col("_key"), F.lit("")).isNotNull()
    keep = F.struct(*[F.col(f"`{c}`") for c in both.columns])
    first = both.filter(known).groupBy("_key").agg(F.min_by(keep, F.struct("_src", order)).alias("_row")).select("_row.*")
    out = first if drop_unkeyed else first.unionByName(both.filter(~known))
    return out.drop("_src", "_key")


def insert_absent(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Existing rows, and new ones whose key is absent; existing rows are never changed."""
    return existing.unionByName(new.join(existing.select(key), key, "left_anti").select(*existing.columns))


def unprocessed(records: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Records whose key is not in the ledger."""
    return records.join(ledger.select(key), key, "left_anti")


def schedule(records: DataFrame, order: str = "year_desc", limit: int = 0, row: str = "_row_idx") -> DataFrame:
    """Records by year (unknown years as the lowest) or as they came; ``limit`` 0 means all."""
    year = F.coalesce(F.col("year").try_cast("int"), F.lit(NO_YEAR))
    keys = {"year_desc": [year.desc(), F.col(row)], "year_asc": [year.asc(), F.col(row)], "input": [F.col(row)]}
    if order not in keys:
        raise ValueError(f"unknown order {order!r}")
    out = records.orderBy(*keys[order])
    return out.limit(limit) if limit > 0 else out


def outcome(found: Column) -> Column:
    """ok above 0 figures, no-source-data for -1, no-figures for 0, fetch-error for null."""
    return F.when(found > 0, "ok").when(found == -1, "no-source-data").when(found == 0, "no-figures").otherwise("fetch-error")


def stop_after_empty(figures: DataFrame, article: str, number: str, found: str, most: int = 2) -> DataFrame:
    """Rows up to where ``most`` figures in a row were missing, per article."""
    w = Window.partitionBy(article).orderBy(number)
    island = F.sum(F.col(found).cast("int")).over(w)
    rows = figures.withColumn("_i", island)
    streak = F.sum((~F.col(found)).cast("int")).over(Window.partitionBy(article, "_i").orderBy(number))
    rows = rows.withColumn("_s", streak)
    stopped = F.max((F.col("_s") >= most).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_x", stopped).filter(F.coalesce("_x", F.lit(0)) == 0).drop("_i", "_s", "_x")


#: A file name's ending.
ENDING = r"(\.[^./\\]*)$"


def unique_names(df: DataFrame, name: str, order: str, out: str = "unique_name") -> DataFrame:
    """Names that differ in any case, given in row order: a taken one gets _2, _3, ... before its ending until it is free.

    Names can only meet within a family (the name without numbers it ends in).  In a family of one name the
    n-th takes _n; the few families with several names are worked through in order, each as a whole.
    """
    rows = df.withColumn("_low", F.lower(F.col(name)))
    stem = F.regexp_replace(F.col("_low"), ENDING, "")
    rows = rows.withColumn("_family", F.concat_ws("\0", F.regexp_replace(stem, r"(_[0-9]+)+$", ""), F.regexp_extract("_low", ENDING, 1)))
    mixed = rows.groupBy("_family").agg((F.min("_low") != F.max("_low")).alias("_mixed"))
    rows = rows.join(mixed, same([rows["_family"]], [mixed["_family"]])).drop(mixed["_family"]).drop("_low")
    n = F.row_number().over(Window.partitionBy("_family").orderBy(order))
    bare, ending = F.regexp_replace(name, ENDING, ""), F.regexp_extract(name, ENDING, 1)
    plain = rows.filter("not _mixed or _mixed is null").withColumn(out, F.when((n == 1) | F.col(name).isNull(), F.col(name)).otherwise(F.concat(bare, F.lit("_"), n, ending)))

    def allot(group):
        group = group.sort_values(order, kind="stable")
        used: set[str] = set()
        names = []
        for whole in group[name]:
            found = re.search(ENDING, whole)
            head, tail = (whole[: found.start()], found.group()) if found else (whole, "")
            k, attempt = 2, whole
            while attempt.lower() in used:
                attempt, k = f"{head}_{k}{tail}", k + 1
            used.add(attempt.lower())
            names.append(attempt)
        return group.assign(**{out: names}).drop(columns=["_family", "_mixed"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` string"
    several = rows.filter("_mixed").groupBy("_family").applyInPandas(allot, schema)
    return plain.drop("_family", "_mixed").unionByName(several)


def keyword_product(base: DataFrame, left: DataFrame, right: DataFrame, most: int = 500) -> DataFrame:
    """Distinct terms: those of ``base`` (term, pos), then every left-right pair, until there are ``most``.

    Word lists are a few hundred entries; the product is bounded by them.
    """
    def placed(term: Column, kind: int, p: Column, q: Column) -> list[Column]:
        return [F.trim(term).alias("term"), F.struct(F.lit(kind).alias("k"), p.cast("long").alias("p"), q.cast("long").alias("q")).alias("o")]

    l_, r = left.toDF("lt", "lp"), right.toDF("rt", "rp")
    pairs = l_.crossJoin(r).select(*placed(F.concat_ws(" ", "lt", "rt"), 1, F.col("lp"), F.col("rp")))
    both = base.toDF("term", "pos").select(*placed(F.col("term"), 0, F.col("pos"), F.lit(0))).unionAll(pairs)
    both = both.filter("term <> ''").groupBy("term").agg(F.min("o").alias("o"))
    return both.orderBy("o").limit(most).select("term")
