import pytest

from figloom.plans import figure as FIG
from figloom.plans import rounds as L
from figloom.plans import spec as P


def cols(kinds, distinct, n):
    return P.Columns(kinds, distinct, n)


def test_share_with_absolute():
    c = cols({"month": "string", "channel": "string", "share": "numeric", "revenue": "numeric"}, {"month": 5, "channel": 3, "share": 12, "revenue": 15}, 15)
    s = P.compose(c, {"chart_family": "area", "x": "month", "y": "share", "group": "channel"})
    got = [(o["mark"], o["variant"], o["y"], o["group"], o["yaxis"]) for o in s["overlays"]]
    assert got == [("area", "stacked", "share", "channel", "left"), ("line", "main", "revenue", None, "right")]
    assert s["stack_mode"] == "normalize"


def test_roles():
    c = cols({"month": "string", "actual": "numeric", "target": "numeric", "plan": "numeric", "baseline": "numeric"}, {"month": 6, "actual": 6, "target": 6, "plan": 6, "baseline": 6}, 6)
    s = P.compose(c, {"chart_family": "line", "x": "month", "y": "actual"})
    assert {o["y"]: o["style"].get("linestyle") for o in s["overlays"][1:]} == {"target": "--", "plan": ":", "baseline": "-."}
    assert all(o["yaxis"] == "left" for o in s["overlays"])


def test_derive_and_validate():
    s = P.derive_spec({"chart_family": "line"}, {"columns": {"m": "datetime", "v": "numeric"}})
    o = P.validate_spec(s)["overlays"][0]
    assert (o["mark"], o["variant"], o["x"], o["y"], o["group"]) == ("line", "main", "m", "v", None)
    with pytest.raises(P.SpecError):
        P.validate_spec({**s, "overlays": []})
    s["overlays"][0]["mark"] = "blob"
    with pytest.raises(P.SpecError):
        P.validate_spec(s)


def test_inference_without_intent():
    c = cols({"region": "string", "price": "numeric", "units": "numeric"}, {"region": 4, "price": 12, "units": 11}, 12)
    assert c.encode({})[:2] == ("region", "price")
    assert not P.Columns({"market": "numeric"}, {}, 9, word_match=True).says("market", ("ma",))


def test_scores_and_texts():
    s = P.derive_spec({}, {"columns": {"a": "string", "b": "numeric", "c": "string"}})
    assert P.score(s)["data_fidelity"] == 0.75
    assert [(d["key"], d["slot"], d["sev"]) for d in P.diagnostics({"overlays": []})] == [("title.missing", "axes.labels", 2)]
    bad = {"overlays": [{}, {}], "layout": {"legend": {"loc": "none"}}, "scales": {"y_left": {"breaks": "x"}, "y_right": {"kind": "log"}}}
    keys = ["title.missing", "legend.overlap", "broken.axis.symbol.missing", "bad.scale.y_right.log", "low.contrast.series.2", "empty.plot"]
    assert [d["key"] for d in P.diagnostics(bad, 0.1)] == keys
    assert P.feedback(P.diagnostics(bad, 0.1)).splitlines()[1].startswith("- [empty.plot] data.aggregate")
    assert P.parse_rules("a: 1\nb:\n  c: true\n  d:\n    - x\n    - 2\n") == {"a": 1, "b": {"c": True, "d": ["x", 2]}}
    assert P.axis_labels(["a", "b"], ["b", "c"]) == ["a", "b (L)", "b (R)", "c"]
    assert P.tick_step(120) == 3 and [P.scale_kind("log", x) for x in (0.1, 0.2)] == ["linear", "log"]
    assert P.image_score([[[0, 0, 0]] * 4] * 4) == 0.1


def test_figure_document(spark):
    df = spark.createDataFrame([("m1", "a", 1.0, 5), ("m1", "b", 3.0, 6), ("m2", "a", 2.0, 7), ("m2", "a", 2.0, 8)], "month string, channel string, share double, units int")
    doc = FIG.figure(df, {"x": "month", "y": "units", "group": "channel", "chart_family": "bar"}, {"data.prepare": lambda d, s: d.filter("units > 5")})
    assert {(r["month"], r["channel"], r["height"]) for r in doc["data"]["bar"]} == {("m1", "b", 6.0), ("m2", "a", 15.0), ("m1", "a", 0.0), ("m2", "b", 0.0)}
    assert [(r["month"], r["channel"]) for r in doc["data"]["bar"]] == [("m1", "a"), ("m2", "a"), ("m1", "b"), ("m2", "b")] and doc["truncated"] == []
    assert FIG.figure(df, {"x": "month", "y": "units", "group": "channel", "chart_family": "bar"}, rows=2)["truncated"] == ["bar", "area"]
    assert doc["legend"] == {"mode": "best", "ncol": 1, "outside": False} and doc["fonts"]["title"] == 1.1 + 0.05 * (len(doc["spec"]["overlays"]) - 1)
    assert doc["ratios"]["bar"] is False and doc["area_style"]["alpha_line"] == pytest.approx(0.8)
    assert doc["y_range"] == (0.0, 8.0) and "bar of units" in doc["alt_text"]


def test_rounds(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")

    class Provider:
        def slots(self, spec):
            return {"data.prepare": lambda d, s: d.filter("v > 1"), "axes.ticks": 1}

    low = lambda d: {"visual_form": 0.1, "data_fidelity": 0.1}
    done = L.run_rounds(df, {"x": "k", "y": "v", "chart_family": "bar"}, Provider(), low, 2, str(tmp_path))
    assert [len(r.document["data"]["bar"]) for r in done] == [2, 1] and done[1].rejected == ["axes.ticks"]
    assert (tmp_path / "iteration_2.json").exists()

    class Broken:
        def slots(self, spec):
            return {"data.prepare": lambda d, s: d.filter("nothing > 1")}

    assert L.run_rounds(df, {"x": "k", "y": "v"}, Broken(), low, 2)[1].rejected == ["data.prepare"]
    assert len(L.run_rounds(df, {}, judge=lambda d: {"visual_form": 1.0, "data_fidelity": 1.0})) == 1


def test_evidence(spark):
    log = L.evidence_table(spark, [L.Link(1, L.Evidence.STYLE, {"a": 1.0}, {"b": 2}), L.Link(2, L.Evidence.STYLE)])
    assert {r["etype"]: r["n"] for r in L.evidence_counts(log).collect()} == {"style": 2, "constraint": 0, "geom": 0, "layout": 0, "ref": 0}
    assert L.json_safe({"a": float("nan"), "b": (1, None)}) == {"a": None, "b": [1, None]}
    prof = L.workbook_profile({"s": spark.createDataFrame([(1,)], "c int")}, lambda d: [{"name": c} for c in d.columns])
    assert prof["column_whitelist"] == {"s": ["c"]}


def plain_mark(family, ratio, time, group, numeric):
    """The rules as prose has them: a family asked for decides; else grouped shares are areas, times lines, groups bars, numbers dots."""
    asked = {"column": "bar", "stacked_bar": "stacked", "bubble": "scatter"}.get(family, family)
    grouped = "grouped" if group else "main"
    by_family = {
        "bar": ("bar", grouped), "stacked": ("bar", "stacked"), "line": ("line", "main"), "scatter": ("scatter", "main"),
        "area": ("area", "stacked" if group and ratio else "fill"), "stacked_area": ("area", "stacked"),
    }
    own = [(group and ratio, ("area", "stacked")), (time, ("line", "main")), (group, ("bar", "grouped")), (numeric, ("scatter", "main")), (True, ("line", "main"))]
    return by_family.get(asked) or next(m for holds, m in own if holds)


def test_mark_table():
    for family in ("bar", "column", "stacked", "stacked_bar", "line", "area", "stacked_area", "scatter", "bubble", "", "pie"):
        for k in range(16):
            ratio, time, group, numeric = (bool(k >> i & 1) for i in range(4))
            names = {"date" if time else "kind": "string", "rate" if ratio else "sum": "numeric" if numeric else "string", "g": "string"}
            x, y, _ = names
            assert P.choose_mark(cols(names, {}, 50), family, x, y, "g" if group else None)[:2] == plain_mark(family, ratio, time, group, numeric)


def test_roles_of_earlier_values_and_ratios_by_value():
    c = cols({"day": "datetime", "sales": "numeric", "sales_last_year": "numeric", "win_rate": "numeric", "cost": "numeric"}, {}, 40)
    got = {o["y"]: (o["mark"], o["yaxis"]) for o in P.compose(c, {"x": "day", "y": "sales"})["overlays"]}
    assert got == {"sales": ("line", "left"), "sales_last_year": ("line", "left"), "win_rate": ("line", "right"), "cost": ("line", "left")}
    assert P.is_ratio(c, "cost", 0.7, 1.2) and not P.is_ratio(c, "cost", 0.7, 2.0) and not P.is_ratio(c, "cost")
    assert P.is_ratio(cols({"up%x": "numeric"}, {}, 1), "up%x", 0.0, 90.0, 10.0)
