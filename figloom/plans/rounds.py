"""Rounds of drawing and judging, data steps given from outside, evidence and run records."""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Iterable, Sequence
from dataclasses import asdict, dataclass, field
from datetime import date, datetime
from enum import StrEnum
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stats import tally
from . import figure as FIG
from . import spec as P

Step = Callable[[DataFrame, dict], DataFrame]

#: Which kinds of slots a layer may fill, fixed values.
LAYERS = {
    "L1": ("spec.",),
    "L2": ("data.",),
    "L3": ("marks.", "scales.", "colorbar.apply"),
    "L4": ("axes.", "legend.apply", "grid.apply", "annot.", "theme."),
}
#: Slots that work on rows; the other layers shape the figure document and belong to a renderer.
DATA_SLOTS = ("data.prepare", "data.aggregate", "data.encode")
PASS = 0.75


def allowed(layer: str, slots: dict[str, Any]) -> tuple[dict[str, Any], list[str]]:
    """The slots that the layer may fill, and the names of those it may not."""
    fits = {k: v for k, v in slots.items() if k.startswith(LAYERS[layer])}
    return fits, [k for k in slots if k not in fits]


class Evidence(StrEnum):
    CONSTRAINT = "constraint"
    STYLE = "style"
    GEOM = "geom"
    LAYOUT = "layout"
    REF = "ref"


LINK = "level int, etype string, delta map<string,double>, patch string, msg string, ts timestamp"


@dataclass(frozen=True)
class Link:
    level: int
    etype: Evidence
    delta: dict[str, float] = field(default_factory=dict)
    patch: dict[str, Any] = field(default_factory=dict)
    msg: str = ""
    ts: float = field(default_factory=time.time)


def evidence_table(spark: SparkSession, links: Iterable[Link]) -> DataFrame:
    rows = [(x.level, str(x.etype), x.delta, json.dumps(x.patch), x.msg, datetime.fromtimestamp(x.ts)) for x in links]
    return spark.createDataFrame(rows, LINK)


def evidence_counts(log: DataFrame) -> DataFrame:
    """Rows per evidence type, 0 for types without rows."""
    return tally(log, "etype", [str(e) for e in Evidence])


def json_safe(v: Any) -> Any:
    """Timestamps as ISO text, numbers that are none as null."""
    if isinstance(v, float) and not math.isfinite(v):
        return None
    if isinstance(v, (datetime, date)):
        return v.isoformat()
    if isinstance(v, dict):
        return {str(k): json_safe(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [json_safe(x) for x in v]
    if hasattr(v, "__dataclass_fields__"):
        return json_safe(asdict(v))
    return v


def write_record(folder: str, name: str, document: Any) -> Path:
    """A run's record as JSON on the driver."""
    path = Path(folder) / f"{name}.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(json_safe(document), ensure_ascii=False, indent=1), encoding="utf-8")
    return path


@dataclass
class Round:
    number: int
    document: dict
    rejected: list[str]
    scores: dict[str, float]


def run_rounds(
    df: DataFrame,
    intent: dict | None = None,
    provider: FIG.SlotProvider | None = None,
    judge: Callable[[dict], dict] | None = None,
    rounds: int = 3,
    folder: str | None = None,
    tell: Callable[[str, dict], None] = lambda event, payload: None,
) -> list[Round]:
    """Draw, judge, feed back, until both scores reach PASS or the rounds are used up.

    From the second round on the provider may give data steps; steps outside
    their layer are rejected, and a failing step falls back to the defaults.
    """
    out: list[Round] = []
    note = ""
    for number in range(1, rounds + 1):
        tell("round_start", {"round": number})
        slots: dict[str, Step] = {}
        rejected: list[str] = []
        if number > 1 and provider is not None:
            slots, rejected = allowed("L2", provider.slots({"intent": intent or {}, "feedback": note}))
        try:
            document = FIG.figure(df, intent, slots)
        except Exception as e:  # a given step failed: the defaults still draw
            if not slots:
                raise
            tell("slots_failed", {"round": number, "error": str(e)[:500]})
            rejected += list(slots)
            document = FIG.figure(df, intent)
        scores = (judge or (lambda d: d["scores"]))(document)
        out.append(Round(number, document, rejected, scores))
        if folder:
            write_record(folder, f"iteration_{number}", {"document": document, "rejected": rejected, "scores": scores})
        tell("round_end", {"round": number, "scores": scores})
        if all(scores[k] >= PASS for k in ("visual_form", "data_fidelity")):
            break
        note = P.feedback(document["diagnostics"])
    return out


def workbook_profile(tables: dict[str, DataFrame], profile: Callable[[DataFrame], Sequence[dict]]) -> dict:
    """Profiles of named tables and the columns that a plan may use."""
    sheets = {name: list(profile(df)) for name, df in tables.items()}
    return {"sheets": sheets, "column_whitelist": {n: [c["name"] for c in cols] for n, cols in sheets.items()}}


def labels_on_both(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """Labels that both tables have."""
    return left.select(F.col(name)).intersect(right.select(F.col(name)))
