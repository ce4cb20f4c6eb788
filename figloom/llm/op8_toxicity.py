"""Toxicity by a factorization machine over hashed terms.

A document's terms are its words and their first letters (lower case, hashed),
each once.  The score is a logistic function of a bias, the terms' weights and
all pairwise interactions (an insult together with a group's name weighs more
than either), which the latent vectors give in linear time.

The machine is fitted on a bounded sample of labelled rows (``sample``, by hash
order of the id); every document is scored where it lies, over its whole text.
Terms enter it by evidence, their own or that of a pair: two terms that say nothing
each but much together (or whose company turns what one says) both get latent vectors.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import documents, unused, whole_text
from .fast_tokens import LETTER, _classes, spans_hash
from .op10_tokens import steps

BITS = 20
PREFIXES = (4, 5, 6, 7)
FACTORS = 4
#: Labelled rows that the fit uses at most.
SAMPLE = 10_000
#: Terms of fewer sampled rows are not used.
LEAST_ROWS = 5
#: Terms, or pairs, whose share of rows differs between the labels by fewer standard errors are not used.
LEAST_Z = 4.0
#: The commonest terms whose pairs are tried, the pair's least evidence, and by how much it must exceed either term's.
PAIR_TERMS, PAIR_Z, PAIR_GAIN = 1_000, 7.0, 3.0
EPOCHS, BATCH, RATE, DECAY = 20, 128, 0.1, 1e-4


def terms(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hashed term) pairs, each once, in order of the text."""
    cls_of, mix = _classes()
    lower = [t.lower() for t in texts]
    code = np.frombuffer("".join(lower).encode("utf-32-le"), np.uint32)
    if not len(code):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ends = np.cumsum([len(t) for t in lower])
    word = np.zeros(len(code) + 2, bool)
    word[1:-1] = cls_of[code] == LETTER
    flip = word[1:] != word[:-1]
    edge = np.zeros(len(code) + 1, bool)
    edge[ends] = edge[0] = True
    start = np.flatnonzero(word[1:] & (flip | edge))
    stop = np.flatnonzero(word[:-1] & (flip | edge))
    row = np.searchsorted(ends, start, side="right").astype(np.uint64)
    keys = []
    for letters in (0, *PREFIXES):
        long = stop - start > letters
        to = start[long] + letters if letters else stop
        h = spans_hash(code, mix, start[long], to) + np.uint64(letters * 0x51ED270B)
        keys.append(row[long] << np.uint64(bits) | (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits))
    both = np.unique(np.concatenate(keys)).astype(np.int64)
    return both >> bits, both & ((1 << bits) - 1)


@dataclass
class Machine:
    """``terms``: the hashed terms in use, in order; weights and latent vectors are theirs."""

    terms: np.ndarray
    bias: float
    weight: np.ndarray
    latent: np.ndarray

    def raw(self, row: np.ndarray, term: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Each row's score before the logistic function, and its sums of latent vectors; ``term`` are places in ``terms``."""
        out = np.full(n, self.bias, np.float64)
        out += np.bincount(row, weights=self.weight[term], minlength=n)
        sums = np.empty((n, self.latent.shape[1]))
        for f in range(self.latent.shape[1]):
            v = self.latent[term, f]
            sums[:, f] = np.bincount(row, weights=v, minlength=n)
            out += 0.5 * (sums[:, f] ** 2 - np.bincount(row, weights=v * v, minlength=n))
        return out, sums

    def score(self, row: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        at = np.searchsorted(self.terms, term)
        used = np.append(self.terms, -1)[at] == term
        return 1 / (1 + np.exp(-np.clip(self.raw(row[used], at[used], n)[0], -30, 30)))


def evidence(total: np.ndarray, toxic: np.ndarray, n: int, n1: float) -> np.ndarray:
    """By how many standard errors the shares of rows that have something differ between the labels."""
    p = total / n
    error = np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / (n - n1)))
    return (toxic / n1 - (total - toxic) / (n - n1)) / error


def chosen_terms(rows: list[np.ndarray], labels: np.ndarray, size: int) -> np.ndarray:
    """Which of the hashed terms the machine uses."""
    total = np.bincount(np.concatenate(rows), minlength=size)
    toxic = np.bincount(np.concatenate([r for r, y in zip(rows, labels, strict=True) if y]), minlength=size)
    n, n1 = len(labels), float(labels.sum())
    z = np.abs(evidence(total, toxic, n, n1))
    seen = (total >= LEAST_ROWS) & (z >= LEAST_Z)
    # pairs of the commonest terms (those of nearly all rows have no pairs of their own)
    common = np.flatnonzero((total >= LEAST_ROWS) & (total <= 0.9 * n))
    common = np.sort(common[np.argsort(-total[common], kind="stable")[:PAIR_TERMS]])
    place = np.full(size, -1)
    place[common] = np.arange(len(common))
    both, both_toxic = np.zeros((2, len(common), len(common)))
    for k in range(0, n, 1024):
        own = [place[r] for r in rows[k : k + 1024]]
        x = np.zeros((len(own), len(common)), np.float32)
        for i, r in enumerate(own):
            x[i, r[r >= 0]] = 1
        both += x.T @ x
        bad = x[labels[k : k + 1024] > 0]
        both_toxic += bad.T @ bad
    zz = np.abs(evidence(both, both_toxic, n, n1))
    own = z[common]
    strong = (both >= 4 * LEAST_ROWS) & (zz >= PAIR_Z) & (zz >= np.maximum(own[:, None], own) + PAIR_GAIN)
    np.fill_diagonal(strong, False)
    seen[common[strong.any(0)]] = True
    return seen


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, factors: int = FACTORS, seed: int = 7) -> Machine:
    """Logistic loss by AdaGrad over shuffled small batches; without labels of both kinds a constant."""
    rng = np.random.default_rng(seed)
    size = 1 << bits
    m = Machine(np.empty(0, np.int64), -30.0, np.zeros(0), np.zeros((0, factors)))
    share = float(labels.mean()) if len(labels) else 0.0
    if share in (0.0, 1.0):
        m.bias = 30.0 if share else -30.0
        return m
    m.bias = float(np.log(share / (1 - share)))
    seen = chosen_terms(rows, labels, size)
    m.terms = np.flatnonzero(seen)
    size = len(m.terms)
    place = np.cumsum(seen) - 1
    rows = [place[r[seen[r]]] for r in rows]
    m.weight, m.latent = np.zeros(size), rng.normal(0, 0.01, (size, factors))
    gw, gv, gb = np.full(size, 1e-6), np.full((size, factors), 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), BATCH):
            part = order[k : k + BATCH]
            own = [rows[i] for i in part]
            term = np.concatenate(own)
            row = np.repeat(np.arange(len(part)), [len(x) for x in own])
            raw, sums = m.raw(row, term, len(part))
            err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[part]) / len(part)
            gb += err.sum() ** 2
            m.bias -= RATE * err.sum() / np.sqrt(gb)
            used, at = np.unique(term, return_inverse=True)
            e = err[row]
            g = np.bincount(at, weights=e) + DECAY * m.weight[used]
            gw[used] += g * g
            m.weight[used] -= RATE * g / np.sqrt(gw[used])
            for f in range(factors):
                v = m.latent[:, f]
                g = np.bincount(at, weights=e * (sums[row, f] - v[term])) + DECAY * v[used]
                gv[used, f] += g * g
                v[used] -= 0.2 * RATE * g / np.sqrt(gv[used, f])
    return m


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is 0 modulo 5; such labels, and those of null ids, are not learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def learn(df: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fit on at most ``sample`` labelled rows of (doc_id, _text) that are not held out."""
    known = labels.filter(F.col("toxic").isNotNull() & ~held_out()).select("doc_id", "toxic")
    bounded = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    rows = df.join(F.broadcast(bounded), "doc_id").select("_text", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in steps(whole, "_text") if whole.num_rows else ():
                row, term = terms(b.column("_text").to_pylist())
                cut = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(term.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([lists, b.column("toxic").cast(pa.int32())], names=["terms", "toxic"])

    # bounded by ``sample``
    got = rows.mapInArrow(run, "terms array<int>, toxic int").toArrow()
    lists = got.column("terms").combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    flat, cut = lists.values.to_numpy(), lists.offsets.to_numpy()
    each = [flat[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
    y = got.column("toxic").to_numpy().astype(np.float64)
    # Spark's order of rows may vary; the fit must not
    order = sorted(range(len(each)), key=lambda i: (zlib.crc32(each[i]), len(each[i]), y[i]))
    return fit([each[i] for i in order], y[order])


def scored(df: DataFrame, labels: DataFrame, into: str, sample: int = SAMPLE, text_col: str = "text") -> DataFrame:
    """All columns of ``df``, as they are, and the score in a column ``into`` (a name that ``df`` does not have)."""
    spark = df.sparkSession
    plain = df.select(F.col("doc_id"), whole_text(text_col).alias("_text"))
    machine = spark.sparkContext.broadcast(learn(plain, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine.value
        for whole in batches:
            for b in steps(whole, text_col) if whole.num_rows else ():
                texts = [t or "" for t in b.column(text_col).to_pylist()]
                score = m.score(*terms(texts), len(texts))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], names=[*b.schema.names, into])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(into, DoubleType())]))


def toxicity(df: DataFrame, labels: DataFrame, sample: int = SAMPLE, text_col: str = "text") -> DataFrame:
    """All columns of ``df`` with ``held_out``, ``score`` (0 to 1) and ``predicted`` (0 or 1).

    Columns of ``df`` that have one of these names are replaced.  A null text counts as empty; an empty one scores
    by the bias.  Null labels are not used, nor those of null ids; several labels of one id count each.  Repeated rows
    are scored each.  Without labels of both kinds every score is near 0 or 1 alike.  An empty table gives no rows.
    """
    into = unused(df, "_score")
    out = scored(df, labels, into, sample, text_col)
    kept = [c for c in df.columns if c.lower() not in ("held_out", "score", "predicted")]
    return out.select(
        *[F.col(f"`{c}`") for c in kept],
        held_out().alias("held_out"),
        F.col(into).alias("score"),
        (F.col(into) >= 0.5).cast("int").alias("predicted"),
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity(documents(spark, sf_dir).select("doc_id", "text"), labels).drop("text")


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLE_SQL: dict[str, str] = {}
