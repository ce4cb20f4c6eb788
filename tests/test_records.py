import json
import random
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from figloom.functions import text as X
from figloom.operators import encode as E
from figloom.operators import extract as H
from figloom.operators import harvest as R
from figloom.operators import marks as M
from figloom.operators import stats as S
from figloom.sources import sinks, tables
from figloom.streaming import ingest

PAGE = """<html><head><meta property="og:image" content="//img.example/a.PNG"><meta name="description" content=" d "></head><body>
<figure><picture><source srcset="/s1.webp 1x, /s2.webp 2x"></picture><img data-src="f.jpg"><img src="f.jpg"></figure>
<figcaption></figcaption><p class="c-caption">The <b>caption</b></p>
<div id="sec"><a href="#x">Source data</a><a href="/d.xlsx">Source  Data Fig. 1</a><a href="/d.xlsx">source data</a></div></body></html>"""


def test_extraction():
    root = H.parse(PAGE)
    assert H.figure_images(root, "https://x.example/p/") == ["https://x.example/p/f.jpg"]
    assert H.best_image(root, "https://x.example/") == "https://img.example/a.PNG"
    assert H.caption(root) == "The caption"
    assert H.labelled_links(root, "https://x.example/", section="sec") == [("Source  Data Fig. 1", "https://x.example/d.xlsx")]
    plain = H.parse('<figure><source srcset="/s1.webp 1x, /s2.webp 2x"></figure>')
    assert H.best_image(plain, "https://x.example/") == "https://x.example/s2.webp"
    links = H.parse('<a href="/a.png">x</a><a href="/full/b.jpg">y</a>')
    assert H.best_image(links, "https://x.example/") == "https://x.example/full/b.jpg"
    data = H.parse('<script type="application/ld+json">{"a": [{"caption": " c "}]}</script>')
    assert H.caption(data) == "c" and H.caption(H.parse(None)) == ""
    assert H.filename("attachment; filename*=UTF-8''a%20b.csv") == "a b.csv"
    assert H.filename('attachment; filename="x.zip"') == "x.zip" and H.filename(None) is None


def test_extract_pages(spark):
    df = spark.createDataFrame([(1, "https://x.example/p/", PAGE), (2, None, None)], "id int, url string, html string")
    one, two = H.extract_pages(df).orderBy("id").collect()
    assert one["caption"] == "The caption" and len(one["links"]) == 1 and two["figures"] == []


def test_merge_and_ledgers(spark):
    old = spark.createDataFrame([("10.1/A", "old", 0)], "doi string, t string, i int")
    new = spark.createDataFrame([("10.1/a", "new", 1), ("10.1/c", "c", 2), (None, "none", 3)], "doi string, t string, i int")
    assert {r["t"] for r in R.merge_first(old, new, R.doi_key(), "i").collect()} == {"old", "c"}
    assert {r["t"] for r in R.merge_first(old, new, R.doi_key(), "i", drop_unkeyed=False).collect()} == {"old", "c", "none"}
    assert R.unprocessed(new, old.select(F.lit("10.1/c").alias("doi")), "doi").count() == 2
    assert R.schedule(spark.createDataFrame([(0, "x"), (1, "2001"), (2, None)], "_row_idx int, year string")).first()["_row_idx"] == 1
    seen = spark.createDataFrame([(1, i, f) for i, f in enumerate([True, False, False, True])], "a int, n int, f boolean")
    assert R.stop_after_empty(seen, "a", "n", "f").count() == 3
    names = spark.createDataFrame([(0, "a"), (1, "A"), (2, "b")], "i int, n string")
    assert [r["unique_name"] for r in R.unique_names(names, "n", "i").orderBy("i").collect()] == ["a", "A_2", "b"]
    fam = spark.createDataFrame([(["Journal"],), (["journal of x"],), (["Other"],), (None,)], "c array<string>")
    assert [r[0] for r in fam.select(R.in_family(F.col("c"), ["journal"], ["journal "])).collect()] == [True, True, False, False]
    out = fam.select(R.outcome(F.lit(3)), R.outcome(F.lit(-1)), R.outcome(F.lit(0)), R.outcome(F.lit(None).cast("int"))).first()
    assert tuple(out) == R.OUTCOMES
    terms = R.keyword_product(*[spark.createDataFrame(x, "t string, p int") for x in ([(" z ", 0)], [("a", 0)], [("b", 0), ("c", 1)])])
    assert [r[0] for r in terms.collect()] == ["z", "a b", "a c"]


def test_urls(spark):
    df = spark.createDataFrame([("HTTP://www.X.example/a/b%20c.PNG?q=1",), ("no",)], "u string")
    r = df.select(X.url_key(F.col("u")), X.url_base(F.col("u")), X.likely_image(F.lower("u"))).first()
    assert tuple(r) == ("x.example/a/b%20c.PNG", "b c.PNG", True)


def workbook(path):
    sheet = lambda rows: "<worksheet xmlns='http://schemas.openxmlformats.org/spreadsheetml/2006/main'><sheetData>" + "".join(
        "<row>" + "".join(f"<c r='{chr(65 + i)}{n}' t='inlineStr'><is><t>{v}</t></is></c>" if isinstance(v, str) else f"<c r='{chr(65 + i)}{n}'><v>{v}</v></c>" for i, v in enumerate(r) if v is not None) + "</row>"
        for n, r in enumerate(rows, 1)
    ) + "</sheetData></worksheet>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", "<workbook xmlns='http://schemas.openxmlformats.org/spreadsheetml/2006/main' xmlns:r='http://schemas.openxmlformats.org/officeDocument/2006/relationships'><sheets><sheet name='One' r:id='r1'/><sheet name='Two' r:id='r2'/></sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships xmlns='x'><Relationship Id='r1' Target='worksheets/s1.xml'/><Relationship Id='r2' Target='worksheets/s2.xml'/></Relationships>")
        z.writestr("xl/worksheets/s1.xml", sheet([["Title"], ["day", "n", "n"], ["2024-01-01", 1, None], ["2024-01-02", 2.5, None]]))
        z.writestr("xl/worksheets/s2.xml", sheet([]))


def test_workbooks(spark, tmp_path):
    workbook(tmp_path / "w.xlsx")
    out = tables.read_workbook(spark, str(tmp_path / "w.xlsx"))
    assert list(out) == ["One"] and out["One"].columns == [tables.ROW, "day", "n"]
    assert [r["n"] for r in out["One"].orderBy(tables.ROW).collect()] == [1.0, 2.5]
    assert dict(out["One"].dtypes)["day"] == "timestamp"
    spark.dataSource.register(tables.WorkbookSource)
    assert spark.read.format("workbook").option("path", str(tmp_path / "w.xlsx")).load().count() == 4


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("\ufeffmonth,value\nJan,1\nFeb,2\n".encode())
    df = tables.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["month", "value", tables.ROW] and df.agg(F.sum("value")).first()[0] == 3
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\nbad\n{"a": 2}\n')
    assert tables.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int").filter("a is not null").count() == 2
    (tmp_path / "ids.txt").write_text("a\n a \n\nb\n")
    assert {r[0] for r in tables.read_lines(spark, str(tmp_path / "ids.txt")).collect()} == {"a", "b"}
    sinks.write_csv(df, str(tmp_path / "o"), ["month", "gone"])
    assert spark.read.csv(str(tmp_path / "o"), header=True).columns == ["month", "gone"]
    sinks.write_jsonl(df, str(tmp_path / "j"))
    sinks.append_ledger(df, str(tmp_path / "l"), "month", "value")
    assert {r[0] for r in ingest.ledger_keys(spark, str(tmp_path / "l")).collect()} == {"Jan", "Feb"}


def test_paged_source(spark):
    def fetch(query, offset, rows):
        return [(f"{query}-{i}",) for i in range(offset, offset + rows)]

    spark.dataSource.register(tables.paged_source(fetch, "id string", 3, 7, "pages7"))
    df = spark.read.format("pages7").option("query", "q").load()
    assert df.count() == 7 and df.distinct().count() == 7


def test_stream_restart(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "doi string"

    def feed(name, ids):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("\n".join(json.dumps({"doi": i}) for i in ids))

    def go():
        s = ingest.first_per_key(ingest.file_stream(spark, src, schema), R.doi_key())
        ingest.append(s, out, state).awaitTermination()
        return sorted(r[0].lower() for r in spark.read.parquet(out).collect())

    feed("a.json", ["x", "Y", "X", None])
    assert go() == ["x", "y"]
    feed("b.json", ["y", "z"])
    assert go() == ["x", "y", "z"]


def test_until_over_restarts(spark, tmp_path):
    """12 rows in 4 files: what is beyond a limit comes with a larger one, and no row comes twice."""
    (tmp_path / "in").mkdir()
    for k in range(4):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps({"doi": f"{k}-{i}" if i < 3 else None}) for i in range(4)))
    held = {}

    def run(limit):
        s = ingest.file_stream(spark, str(tmp_path / "in"), "doi string", 1)
        n = ingest.until(s, str(tmp_path / "state"), limit, lambda d: d.filter("doi is not null"), lambda d, k: held.update({k: [r[0] for r in d.collect()]}))
        rows = [x for b in held.values() for x in b]
        assert n == len(rows) == len(set(rows))
        return n

    assert [run(4), run(4), run(6), run(100), run(100)] == [4, 4, 6, 12, 12]


def plain_names(names):
    used, out = set(), []
    for n in names:
        found = re.search(r"\.[^./\\]*$", n)
        head, tail = (n[: found.start()], found.group()) if found else (n, "")
        k, attempt = 2, n
        while attempt.lower() in used:
            attempt, k = f"{head}_{k}{tail}", k + 1
        used.add(attempt.lower())
        out.append(attempt)
    return out


def test_unique_names_try_until_free(spark):
    g = random.Random(4)
    names = ["a", "a", "a_2", "x.png", "X.png", "x_2.PNG", "b.tar.gz", "B.tar.gz", "a_2_2", "a"]
    names += [g.choice("ab") + g.choice(["", "_2", "_3", "_2_2"]) + g.choice(["", ".x", ".Y"]) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(names)), "i int, n string")
    got = [r["unique_name"] for r in R.unique_names(df, "n", "i").orderBy("i").collect()]
    assert got == plain_names(names) and len({x.lower() for x in got}) == len(got)
    assert got[:6] == ["a", "a_2", "a_2_2", "x.png", "X_2.png", "x_2_2.PNG"]


def test_drawing_order_and_guarded_times(spark):
    rows = [(0, "b", "s2", "2024-03-01"), (1, "a", "s1", "2024-01-01"), (2, "b", "s1", None), (3, None, "s2", "2024-02-01"), (4, "a", "s2", "x")]
    df = spark.createDataFrame(rows, "i int, c string, s string, t string")
    ids = lambda d: [r["i"] for r in d.collect()]
    assert ids(E.drawing_order(df, "c", "i")) == [0, 2, 1, 4, 3]
    assert ids(E.drawing_order(df, "c", "i", "s")) == [0, 4, 3, 2, 1]
    timed = E.guarded_moment(df, "t")
    assert timed.schema["t"].dataType.simpleString() == "timestamp" and ids(E.drawing_order(timed, "t", "i")) == [1, 3, 0, 2, 4]
    assert E.guarded_moment(df, "c").schema == E.guarded_moment(df, "t", False).schema == df.schema
    assert E.guarded_moment(df.limit(2), "t").schema == df.schema  # two are too few


def test_quantiles_of_large_and_small_groups(spark):
    g = np.random.default_rng(5)
    groups = {"big": g.normal(size=40_001), "ties": g.integers(0, 5, 30_000).astype(float), "small": g.normal(size=7), "one": np.array([3.0]), None: g.normal(size=12_345)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "k string, v double")
    shares = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = {r[0]: list(r)[1:] for r in S.quantiles(df, "v", shares, ["k"]).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert np.allclose(got[k], np.quantile(vs, shares), atol=1e-12)
    assert S.quantiles(df.limit(0), "v", (0.5,)).collect() in ([], [(None,)])


def test_density_by_bins(spark):
    v = np.random.default_rng(6).normal(size=5_000)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    exact = {r["i"]: r["density"] for r in M.violin(df, "v", grid=20, bins=10_000).collect()}
    binned = {r["i"]: r["density"] for r in M.violin(df, "v", grid=20, bins=512).collect()}
    assert len(exact) == 20 and all(abs(exact[i] - binned[i]) < 1e-4 for i in exact)


def test_grid_of_too_many_columns(spark):
    df = spark.range(50).selectExpr("id % 3 as a", "id as b", "1.0 as v")
    assert E.dense_grid(df, "a", "b", "v", most=50).count() == 150
    with pytest.raises(ValueError):
        E.dense_grid(df, "a", "b", "v", most=49)
