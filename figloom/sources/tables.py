"""Table readers: CSV and workbooks with row order, JSON lines, line sets, paged search."""

from __future__ import annotations

import io
import re
import time
import zipfile
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import values as V

ROW = "_row_idx"


def with_row_index(df: DataFrame, name: str = ROW) -> DataFrame:
    """A file scan's rows numbered from 0 by file path and place in it, whatever order the splits are read in.

    One row per split is counted first; rows of a split keep its order.
    """
    split = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")]
    rows = df.select("*", *split, F.monotonically_increasing_id().alias("_at"))
    splits = rows.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.withColumn("_before", before)
    out = rows.join(F.broadcast(splits), ["_file", "_start"])
    return out.select(*df.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias(name))


def read_csv(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """A CSV file with a header; types are inferred unless a schema is given."""
    reader = spark.read.options(header=True, **options)
    return with_row_index((reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and malformed lines are skipped."""
    return with_row_index(spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path))


def read_lines(spark: SparkSession, path: str, name: str = "value") -> DataFrame:
    """The distinct trimmed non-empty lines."""
    lines = spark.read.text(path).select(F.trim("value").alias(name))
    return lines.filter(F.col(name) != "").distinct()


# workbooks

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column_number(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def workbook_cells(data: bytes) -> Iterator[tuple[str, list[list[str | None]]]]:
    """(sheet, rows of texts) of an .xlsx file; dates come as ISO texts."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS):
                shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
        dates: set[int] = set()
        if "xl/styles.xml" in z.namelist():
            styles = ElementTree.fromstring(z.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{{{_NS['m']}}}numFmt")}
            formats = styles.find("m:cellXfs", _NS)
            for i, xf in enumerate(formats if formats is not None else ()):
                k = int(xf.get("numFmtId", 0))
                if 14 <= k <= 22 or re.search(r"[yd]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(k, "")), re.I):
                    dates.add(i)
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{{{_NS['m']}}}sheet"):
            target = rels[s.get(_REL)].lstrip("/")
            rows = []
            for row in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{{{_NS['m']}}}row"):
                values: list[str | None] = []
                for c in row.findall("m:c", _NS):
                    at = _column_number(c.get("r")) if c.get("r") else len(values)
                    values += [None] * (at - len(values))
                    v, kind = c.find("m:v", _NS), c.get("t")
                    text = v.text if v is not None else None
                    if kind == "s" and text is not None:
                        text = shared[int(text)]
                    elif kind == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                    elif kind == "b" and text is not None:
                        text = "true" if text == "1" else "false"
                    elif kind in (None, "n") and text and int(c.get("s", 0)) in dates:
                        text = (datetime(1899, 12, 30) + timedelta(days=float(text))).strftime("%Y-%m-%d %H:%M:%S")
                    values.append(text)
                rows.append(values)
            yield s.get("name"), rows


class WorkbookSource(DataSource):
    """``spark.read.format("workbook").option("sheet", ...).load(path)``: one sheet's cells as c0, c1, ... texts."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def _rows(self) -> list[list[str | None]]:
        with open(self.options["path"], "rb") as f:
            sheets = list(workbook_cells(f.read()))
        wanted = self.options.get("sheet")
        return next((r for n, r in sheets if wanted is None or n.lower() == wanted.lower()), [])

    def schema(self) -> StructType:
        width = max((len(r) for r in self._rows()), default=1)
        return StructType([StructField(f"c{i}", StringType()) for i in range(width)])

    def reader(self, schema: StructType) -> DataSourceReader:
        rows, width = self._rows(), len(schema)

        class Reader(DataSourceReader):
            def read(self, partition: InputPartition) -> Iterator[tuple]:
                for r in rows:
                    yield tuple((r + [None] * width)[:width])

        return Reader()


def read_workbook(spark: SparkSession, path: str, sheets: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Each sheet of an .xlsx file as a table: header found, empty rows and columns dropped, types inferred."""
    data = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    wanted = {s.lower() for s in sheets} if sheets else None
    out = {}
    for name, rows in workbook_cells(data):
        width = max((len(r) for r in rows), default=0)
        if (wanted and name.lower() not in wanted) or not width:
            continue
        schema = ", ".join([f"{ROW} long", *[f"c{i} string" for i in range(width)]])
        raw = spark.createDataFrame([(i, *(r + [None] * width)[:width]) for i, r in enumerate(rows)], schema)
        out[name] = tidy_sheet(raw)
    return out


def header_like(c: Column) -> Column:
    return F.coalesce(F.length(F.trim(c)).between(1, 32) & F.trim(c).try_cast("double").isNull(), F.lit(False))


def header_row(raw: DataFrame, most: int = 200) -> int:
    """The row that looks most like a header: filled, short and distinct texts count; the first of equals."""
    cells = F.array(*[F.col(c) for c in raw.columns if c != ROW])
    known = F.filter(cells, lambda c: c.isNotNull())
    score = 1.5 * F.size(known) + 2.5 * F.size(F.filter(cells, header_like)) + F.size(F.array_distinct(known))
    head = raw.orderBy(ROW).limit(most)
    best = head.select(ROW, score.alias("s")).orderBy(F.col("s").desc(), ROW).first()
    return best[0] if best else 0


def unique_columns(names: Sequence[str | None]) -> list[str]:
    """Empty names become ``column``; repeats get _2, _3, ..."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        base = (n or "").strip() or "column"
        seen[base] = seen.get(base, 0) + 1
        out.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    return out


def drop_empty(df: DataFrame) -> DataFrame:
    """Without columns and rows that hold nothing."""
    names = [c for c in df.columns if c != ROW]
    counts = df.agg(*[F.count(f"`{c}`").alias(c) for c in names]).first()
    kept = [c for c in names if counts[c]]
    return df.select(ROW, *[F.col(f"`{c}`") for c in kept]).na.drop("all", subset=kept) if kept else df.select(ROW).limit(0)


def infer_types(df: DataFrame, share: float = 0.7) -> DataFrame:
    """Text columns become numbers, else timestamps, where more than ``share`` of all rows parse."""
    names = [f.name for f in df.schema if isinstance(f.dataType, StringType)]
    if not names:
        return df
    tests = [(c, k, f(F.col(f"`{c}`"))) for c in names for k, f in (("n", V.number), ("t", V.moment))]
    r = df.agg(*[F.avg(v.isNotNull().cast("double")).alias(f"{c}__{k}") for c, k, v in tests]).first()
    for c in names:
        if (r[f"{c}__n"] or 0) > share:
            df = df.withColumn(c, V.number(F.col(f"`{c}`")))
        elif (r[f"{c}__t"] or 0) > share:
            df = df.withColumn(c, V.moment(F.col(f"`{c}`")))
    return df


def tidy_sheet(raw: DataFrame) -> DataFrame:
    """A sheet's cells as a typed table."""
    at = header_row(raw)
    names = [c for c in raw.columns if c != ROW]
    head = raw.filter(F.col(ROW) == at).select(*names).first()
    body = raw.filter(F.col(ROW) > at).select(ROW, *names)
    return infer_types(drop_empty(body.toDF(ROW, *unique_columns(list(head) if head else names))))


# paged search


class Page(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)


def paged_source(fetch, schema: str, page_rows: int, most: int, source_name: str = "paged") -> type[DataSource]:
    """A data source over ``fetch(query, offset, rows)``: fixed pages as partitions until ``most`` rows."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return source_name

        def schema(self) -> str:
            return schema

        def reader(self, schema: StructType) -> DataSourceReader:
            query = self.options.get("query", "")

            class Reader(DataSourceReader):
                def partitions(self) -> list[Page]:
                    return [Page(i) for i in range(-(-most // page_rows))]

                def read(self, partition: Page) -> Iterator[tuple]:
                    at = partition.value * page_rows
                    yield from fetch(query, at, min(page_rows, most - at)) or ()

            return Reader()

    return Paged


def retrying(fetch, tries: int = 3, sleep: float = 1.0, errors: tuple = (OSError,)):
    """``fetch`` that is called again after an error, after waits that double; the last error is raised."""

    def call(*args):
        for n in range(1, tries + 1):
            try:
                return fetch(*args)
            except errors:
                if n == tries:
                    raise
                time.sleep(sleep * 2 ** (n - 1))

    return call


def cursor_source(fetch, schema: str, page_rows: int, most: int, source_name: str = "cursor") -> type[DataSource]:
    """A data source over ``fetch(query, cursor, rows) -> (rows, next cursor)``: pages one after the other, as each
    names the next, until ``most`` rows, a page without a next cursor, or none at all (None: not found)."""

    class Cursor(DataSource):
        @classmethod
        def name(cls) -> str:
            return source_name

        def schema(self) -> str:
            return schema

        def reader(self, schema: StructType) -> DataSourceReader:
            query = self.options.get("query", "")

            class Reader(DataSourceReader):
                def read(self, partition: InputPartition | None) -> Iterator[tuple]:
                    cursor, left = None, most
                    while left > 0:
                        page = fetch(query, cursor, min(page_rows, left))
                        if page is None:
                            return
                        rows, cursor = page
                        yield from rows[:left]
                        left -= len(rows)
                        if not rows or cursor is None:
                            return

            return Reader()

    return Cursor
