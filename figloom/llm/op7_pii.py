r"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust a score.

Everything is Spark SQL.  Positions come from cutting a text at the matches
and adding up the lengths of pieces and matches, all in code points.

The patterns used are the contract's, written for a backtracking engine so that
very long runs cost linear time: possessive repeats where nothing can be given
back, and a look-behind (or ``\G``, the end of the last match) that skips
starts inside a run whose first start has failed.  They find the same matches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, whole_text

#: Code points before a span in which context words count, what they add or take (hundredths), the score an added kind needs.
CONTEXT, CUE, ACCEPT = 40, 30, 60


@dataclass(frozen=True)
class Kind:
    """``base``: always reported when its checks hold; others need a score of ACCEPT.

    ``score`` is that of a match that passed its checks; words of ``cues`` before it add CUE, words of ``against`` take it off.
    """

    name: str
    pattern: str
    plain: str
    score: int
    cues: str
    base: bool = True
    against: str = ""


# The lengths of account numbers by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT ST",
    26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU",
    31: "MT SC", 32: "LC",
}
IBAN = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())

KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        70,
        "mail|contact|write",
    ),
    Kind(
        "ip",
        r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        60,
        "ip|host|server|address",
        against="version|section",
    ),
    Kind(
        "card",
        r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){13,}+",
        r"[0-9]([\x20-]?[0-9])+",
        60,
        "card|visa|pay|credit",
        against="order|invoice|isbn",
    ),
    Kind(
        "phone",
        r"\+[0-9][ ().0-9-]+[0-9]",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        60,
        "call|tel|phone|mobile|fax",
    ),
    # accepted by its checksum unless words speak against it
    Kind("iban", f"(?=[A-Z]{{2}}[0-9]{{2}})(?:{IBAN})", IBAN, 60, "iban|account|bank", False, "order|serial|isbn"),
    # accepted by words only
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 30, "ssn|social|security", False, "order|isbn"),
    Kind(
        "secret",
        r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+",
        r"[A-Za-z0-9_-]{20,}",
        30,
        "token|secret|passw|credential|api.?key|access.?key|private.?key|bearer",
        False,
        "sha1|sha256|md5|checksum|commit",
    ),
)


def luhn_ok(digits: Column) -> Column:
    """The Luhn checksum of a string of digits."""
    figures = F.transform(F.reverse(F.filter(F.split(digits, ""), lambda c: c != "")), lambda c: c.cast("int"))
    doubled = F.transform(figures, lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97_ok(code: Column) -> Column:
    """The mod-97 checksum of an account number: its first four characters move to the end, letters count from 10."""
    moved = F.concat(F.substr(code, F.lit(5)), F.substr(code, F.lit(1), F.lit(4)))
    chars = F.filter(F.split(moved, ""), lambda c: c != "")

    def step(acc: Column, c: Column) -> Column:
        v = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (acc * F.when(v < 10, 10).otherwise(100) + v) % 97

    return F.aggregate(chars, F.lit(0), step) == 1


def _valid(kind: Kind, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind.name == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.cast("double") <= 255)
    if kind.name == "card":
        return F.length(digits).between(14, 19) & F.when(F.length(digits) <= 19, luhn_ok(digits)).otherwise(False)
    if kind.name == "phone":
        return F.length(digits).between(10, 15)
    if kind.name == "iban":
        return mod97_ok(F.replace(m, F.lit(" "), F.lit("")))
    if kind.name == "ssn":
        area, group, serial = (F.substr(m, F.lit(a), F.lit(n)) for a, n in ((1, 3), (5, 2), (8, 4)))
        return ~area.isin("000", "666") & (area < "900") & (group != "00") & (serial != "0000")
    if kind.name == "secret":
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    return F.lit(True)


#: Matches whose positions are added up at once: the work is linear in blocks of them.
BLOCK = 256


def _ends(cut: Column) -> Column:
    """The end of each match: running sums of the lengths of pieces and matches, within blocks and then over blocks."""
    start = lambda: F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def within(part: Column) -> Column:
        def step(acc: Column, z: Column) -> Column:
            at = acc["at"] + F.length(z["p"]) + F.coalesce(F.length(z["m"]), F.lit(0))
            return F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out"))

        return F.aggregate(part, start(), step)

    def add(acc: Column, run: Column) -> Column:
        return F.struct((acc["at"] + run["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    numbers = F.sequence(F.lit(0), F.floor((F.size(cut) - 1) / BLOCK).cast("int"))
    runs = F.transform(numbers, lambda k: within(F.slice(cut, k * BLOCK + 1, BLOCK)))
    # few: one entry per block, held once
    both = F.transform(F.array(runs), lambda r: F.zip_with(r, F.aggregate(r, start(), add, lambda a: a["out"]), _moved))
    return F.flatten(F.get(both, F.lit(0)))


def _moved(run: Column, by: Column) -> Column:
    return F.transform(run["out"], lambda x: x + by)


def _spans(kind: Kind, number: int, cut: Column, ends: Column) -> Column:
    def one(z: Column, end: Column) -> Column:
        before = F.lower(F.right(z["p"], F.lit(CONTEXT)))
        score = F.lit(kind.score) + F.when(before.rlike(kind.cues), CUE).otherwise(0)
        if kind.against:
            score = score - F.when(before.rlike(kind.against), CUE).otherwise(0)
        score = F.least(F.lit(100), F.greatest(F.lit(0), score))
        good = z["m"].isNotNull() & _valid(kind, z["m"]) & F.lit(True if kind.base else score >= ACCEPT)
        span = F.struct((end - F.length(z["m"])).alias("start"), F.lit(number).alias("kind"), end.alias("end"), score.alias("score"))
        return F.when(good, span)

    kinds = "array<struct<start:int,kind:int,end:int,score:int>>"
    found = F.filter(F.zip_with(cut, ends, one), lambda s: s.isNotNull())
    return F.coalesce(found.cast(kinds), F.array().cast(kinds))


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: its id and ``found``, an array of (start, kind number, end, score) in order of start, then kind.

    Scores are hundredths.  A null text counts as empty and gives an empty array; ids may be null or
    repeat, each row is judged alone; an empty table gives no rows; other columns are ignored.
    """
    rows = df.select(F.col(id_col).alias("_own"), whole_text(text_col).alias("_t"))
    cuts = []
    for k in KINDS:
        cut = F.arrays_zip(F.split("_t", k.pattern, -1).alias("p"), F.regexp_extract_all("_t", F.lit(k.pattern), F.lit(0)).alias("m"))
        cuts.append(F.when(F.col("_t").rlike(k.pattern), cut).alias(f"_cut_{k.name}"))
    # columns of their own: what a lambda uses is not worked out again for each element
    rows = rows.select("_own", *cuts)
    rows = rows.select("*", *[F.when(F.col(f"_cut_{k.name}").isNotNull(), _ends(F.col(f"_cut_{k.name}"))).alias(f"_end_{k.name}") for k in KINDS])
    each = [_spans(k, i, F.col(f"_cut_{k.name}"), F.col(f"_end_{k.name}")) for i, k in enumerate(KINDS)]
    return rows.select(F.col("_own").alias(id_col), F.array_sort(F.concat(*each)).alias("found"))


def _joined(found: Column) -> Column:
    names = F.array(*[F.lit(k.name) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])
    return F.array_join(F.transform(found, one), ",")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns and ``scores``, the spans' scores in their order."""
    found = find_pii(documents(spark, sf_dir))
    base = [i for i, k in enumerate(KINDS) if k.base]

    def count(i: int) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == i)).cast("long").alias(f"n_{KINDS[i].name}")

    return found.select(
        "doc_id",
        *[count(i) for i in base],
        F.sha2(_joined(F.filter("found", lambda s: s["kind"] < len(base))), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
        F.array_join(F.transform("found", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


QUERIES = {"op7_pii": op7_pii}


def _oracle() -> str:
    checks = {
        "ip": "len(list_filter(string_split(m, '.'), lambda p: try_cast(p AS DOUBLE) > 255)) = 0",
        "card": """length(d) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i:
            CASE WHEN (length(d) - i) % 2 = 0 THEN CAST(d[i] AS INTEGER)
                 ELSE CAST(d[i] AS INTEGER) * 2 - CASE WHEN CAST(d[i] AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0""",
        "phone": "length(d) BETWEEN 10 AND 15",
        "iban": """list_reduce(list_prepend(0, list_transform(string_split(replace(m, ' ', '')[5:] || replace(m, ' ', '')[1:4], ''), lambda c: ascii(c))),
            lambda a, c: CASE WHEN c < 58 THEN (a * 10 + c - 48) % 97 ELSE (a * 100 + c - 55) % 97 END) = 1""",
        "ssn": "m[1:3] NOT IN ('000', '666') AND m[1:3] < '900' AND m[5:6] <> '00' AND m[8:11] <> '0000'",
        "secret": "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')",
    }
    parts = []
    for i, k in enumerate(KINDS):
        less = f" - CASE WHEN regexp_matches(near, '{k.against}') THEN {CUE} ELSE 0 END" if k.against else ""
        score = f"least(100, greatest(0, {k.score} + CASE WHEN regexp_matches(near, '{k.cues}') THEN {CUE} ELSE 0 END{less}))"
        parts.append(
            f"""SELECT * FROM (SELECT doc_id, {i} AS kind, s, s + length(m) AS e, {score} AS score FROM (
  SELECT doc_id, m, regexp_replace(m, '[^0-9]', '', 'g') AS d, lower(right(before, {CONTEXT})) AS near,
         sum(length(before) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m) AS s
  FROM (SELECT doc_id, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(ps[1:len(ms)]) AS before FROM (
    SELECT doc_id, regexp_extract_all(t, '{k.plain}') AS ms, string_split_regex(t, '{k.plain}') AS ps
    FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)))
) WHERE {checks.get(k.name, "true")}) WHERE {"true" if k.base else f"score >= {ACCEPT}"}"""
        )
    names = ", ".join(f"'{k.name}'" for k in KINDS)
    return (
        "WITH f AS (" + "\nUNION ALL\n".join(parts) + f"""), g AS (
SELECT doc_id, kind, ([{names}])[kind + 1] || ':' || s || ':' || e AS x, s, score FROM f)
SELECT d.doc_id, count(*) FILTER (WHERE kind = 0) AS n_email, count(*) FILTER (WHERE kind = 1) AS n_ip,
       count(*) FILTER (WHERE kind = 2) AS n_card, count(*) FILTER (WHERE kind = 3) AS n_phone,
       sha256(coalesce(string_agg(x, ',' ORDER BY s, kind) FILTER (WHERE kind < 4), '')) AS base_sha256,
       coalesce(string_agg(x, ',' ORDER BY s, kind), '') AS spans,
       coalesce(string_agg(CAST(score AS VARCHAR), ',' ORDER BY s, kind), '') AS scores
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id GROUP BY d.doc_id"""
    )


ORACLE_SQL = {"op7_pii": _oracle()}
