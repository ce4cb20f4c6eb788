"""Benchmark decontamination: BM25 over test items, block-max WAND, then overlap.

The index holds test items only.  Their statistics (documents per term, number and mean length of
all items) are counted by Spark; the index is built block by block (``block_items`` items
at a time, so the driver holds one block), sent to the executors, and every passage of
every document is a query, answered where the text lies.  No document moves.  One pass over
the text serves PASS_BLOCKS blocks.

* A passage is a window of words, moved by half, that belongs to an item's length: twice
  the least power of two (32 at least) that is not below it.  So an item always lies
  whole within a passage, and what is found does not depend on the other items.
* A score is BM25 divided by the item's score for itself, so one threshold
  serves all items.
* WAND, for all passages of a batch at once instead of by one cursor: the commonest
  terms of an item, of shares that sum to a part of the threshold are optional.  A passage
  without any other term of an item cannot reach it, so only postings of the other (essential)
  terms are read.  Bounds per block of postings (sums of block maxima plus the block's largest
  optional share) skip blocks, then exact partial sums skip items.  These skips change no result.
* What is left is scored in full.  A passage at or above the threshold is
  kept if it holds (a) 0.8 of the item's 5-word shingles, and of the words of its
  question and of its answer each; an item without a question mark or with an
  answer of under five words is judged as a whole; or (b) 0.9 of the shingles; or
  (c) all of an item of five words or more but what one changed, cut or added
  word can take: five of its shingles and two of its pairs of neighbouring words.
  So a question without a long answer is none, unless it is nearly the whole item.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialise, whole_text
from .fast_tokens import SPACE, OTHER, _classes, spans_hash
from .op10_tokens import steps

K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.8
#: Share of an item's shingles that is a leak whatever is missing, and distinct words below which an answer is not judged alone.
HIGH, SHORT = 0.9, 5
WORDS = 5
#: Items of an index that is sent to executors, and of a block of its postings.
INDEX_ITEMS, BLOCK = 20_000, 16
#: Blocks of items that one pass over the text serves.
PASS_BLOCKS = 4
#: Words by which the passages for the shortest items move.
LEAST_STEP = 32
MAP_BITS = 22


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each word: a run of letters and digits in lower case."""
    cls_of, mix = _classes()
    lower = [t.lower() for t in texts]
    code = np.frombuffer("".join(lower).encode("utf-32-le"), np.uint32)
    if not len(code):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    ends = np.cumsum([len(t) for t in lower])
    kind = cls_of[code]
    word = np.zeros(len(code) + 2, bool)
    word[1:-1] = (kind != SPACE) & (kind != OTHER)
    cut = word[1:] != word[:-1]
    cut[0] = cut[-1] = True
    cut[ends] = True
    start, stop = np.flatnonzero(word[1:] & cut), np.flatnonzero(word[:-1] & cut)
    return np.searchsorted(ends, start, side="right"), spans_hash(code, mix, start, stop)


def shingles(h: np.ndarray, words: int) -> np.ndarray:
    """Hashes of runs of ``words`` words; of fewer words, of all of them."""
    n = min(words, len(h))
    if not n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
        out ^= out >> np.uint64(29)
    return out


def question_and_answer(text: str) -> tuple[str, str]:
    """Cut after the last question mark, else before the last sentence; one sentence is both."""
    for pattern in (r"\?\s+(?=[^?]*$)", r"(?<=[.!:])\s+(?=[^.!:]*[.!]?\s*$)"):
        found = list(re.finditer(pattern, text))
        if found and text[: found[-1].end()].strip() and text[found[-1].end() :].strip():
            return text[: found[-1].end()], text[found[-1].end() :]
    return text, text


def length_class(words: int) -> int:
    """The step of the passages for an item of so many words."""
    return max(LEAST_STEP, 1 << max(0, words - 1).bit_length())


@dataclass
class Index:
    items: list
    lengths: list[int]
    whole: list[np.ndarray]
    question: list[np.ndarray]
    answer: list[np.ndarray]
    pairs: list[np.ndarray]
    as_whole: list[bool]
    share: list[tuple[np.ndarray, np.ndarray]]
    optional: np.ndarray
    terms: np.ndarray
    post: tuple[np.ndarray, np.ndarray, np.ndarray]
    block_post: tuple[np.ndarray, np.ndarray, np.ndarray]
    block_optional: np.ndarray
    bitmap: np.ndarray
    step: int
    threshold: float
    overlap: float
    words: int


def build(
    rows: list[tuple[object, str]], df_of: dict[int, int], n_items: int, mean_len: float,
    threshold: float = THRESHOLD, overlap: float = OVERLAP, words: int = WORDS, optional_share: float = 0.7,
) -> Index:
    """The index of (item id, text) rows of one length class; ``df_of`` counts items per term over all blocks."""
    items, lengths, whole, question, answer, pairs, as_whole, share = [], [], [], [], [], [], [], []
    for item, text in rows:
        h = words_of([text])[1]
        if not len(h):
            continue
        q, a = (words_of([x])[1] for x in question_and_answer(text))
        term, tf = np.unique(h, return_counts=True)
        df = np.array([df_of[int(t)] for t in term])
        idf = np.log(1 + (n_items - df + 0.5) / (df + 0.5))
        gain = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(h) / mean_len))
        items.append(item)
        lengths.append(len(h))
        whole.append(np.unique(shingles(h, words)))
        question.append(np.unique(q if len(q) else h))
        answer.append(np.unique(a if len(a) else h))
        pairs.append(np.unique(shingles(h, 2)))
        as_whole.append("?" not in question_and_answer(text)[0] or len(answer[-1]) < SHORT)
        share.append((term, gain / gain.sum()))
    optional = np.zeros(len(items))
    essential: list[tuple[int, int, float]] = []
    vocabulary = np.unique(np.concatenate([t for t, _ in share])) if share else np.empty(0, np.uint64)
    needed = np.zeros(len(vocabulary), bool)
    rank = np.array([df_of[int(t)] for t in vocabulary], np.int64)
    left = np.full(len(items), threshold * optional_share)
    holders: dict[int, list[tuple[int, float]]] = {}
    for i, (term, gain) in enumerate(share):
        for t, g in zip(np.searchsorted(vocabulary, term).tolist(), gain.tolist(), strict=True):
            holders.setdefault(t, []).append((i, g))
    # the commonest terms first: a term is optional for all its items or for none
    for t in np.argsort(-rank, kind="stable").tolist():
        if all(optional[i] + g < left[i] for i, g in holders[t]):
            for i, g in holders[t]:
                optional[i] += g
        else:
            needed[t] = True
            essential += [(t, i, g) for i, g in holders[t]]
    number = np.cumsum(needed) - 1
    terms = vocabulary[needed]
    t = number[np.array([x[0] for x in essential], np.int64)] if essential else np.empty(0, np.int64)
    i = np.array([x[1] for x in essential], np.int64)
    g = np.array([x[2] for x in essential])
    order = np.lexsort((i, t))
    t, i, g = t[order], i[order], g[order]
    off = np.searchsorted(t, np.arange(len(terms) + 1))
    key = t * (len(items) // BLOCK + 1) + i // BLOCK
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    top = np.maximum.reduceat(g, first) if len(first) else g
    block_off = np.searchsorted(t[first], np.arange(len(terms) + 1))
    blocks = -(-len(items) // BLOCK)
    block_optional = np.array([optional[k * BLOCK : (k + 1) * BLOCK].max() for k in range(blocks)])
    bitmap = np.zeros(1 << MAP_BITS, bool)
    bitmap[(terms >> np.uint64(64 - MAP_BITS)).astype(np.int64)] = True
    step = max(length_class(n) for n in [0, *lengths])
    return Index(
        items, lengths, whole, question, answer, pairs, as_whole, share, optional, terms, (off, i, g), (block_off, i[first] // BLOCK, top),
        block_optional, bitmap, step, threshold, overlap, words,
    )


def _spread(off: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For terms t the places of their postings, and which entry of t each belongs to."""
    n = off[t + 1] - off[t]
    owner = np.repeat(np.arange(len(t)), n)
    return off[t][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n), owner


def query(index: Index, texts: list[str]) -> list[tuple[int, int, float, float, float, float]]:
    """(text number, item number, score, overlap of item, question and answer), the best passage of each pair."""
    return search(index, *words_of(texts), len(texts))


def search(index: Index, row: np.ndarray, h: np.ndarray, n_texts: int) -> list[tuple[int, int, float, float, float, float]]:
    """``query`` for texts whose words are given."""
    if not len(h) or not len(index.terms):
        return []
    begin = np.searchsorted(row, np.arange(n_texts + 1))
    seg = (np.arange(len(h)) - begin[row]) // index.step
    last = np.maximum((np.diff(begin) - 1) // index.step - 1, 0)  # the last window of each text
    base = np.cumsum(last + 1) - (last + 1)  # its first window's number
    maybe = np.flatnonzero(index.bitmap[(h >> np.uint64(64 - MAP_BITS)).astype(np.int64)])
    at = np.minimum(np.searchsorted(index.terms, h[maybe]), len(index.terms) - 1)
    hit = index.terms[at] == h[maybe]
    pos, term = maybe[hit], at[hit]
    if not len(pos):
        return []
    r, s = row[pos], seg[pos]
    own, before = s <= last[r], s >= 1
    window = np.concatenate([(base[r] + s)[own], (base[r] + s - 1)[before]])
    key = np.unique(window * len(index.terms) + np.concatenate([term[own], term[before]]))
    window, term = key // len(index.terms), key % len(index.terms)

    # bounds per block of items, then exact partial sums per item
    off, block, top = index.block_post
    place, owner = _spread(off, term)
    nb = len(index.block_optional)
    key, inverse = np.unique(window[owner] * nb + block[place], return_inverse=True)
    alive = key[np.bincount(inverse, weights=top[place]) + index.block_optional[key % nb] >= index.threshold]
    if not len(alive):
        return []
    keep = np.isin(window, alive // nb)
    window, term = window[keep], term[keep]
    off, item, gain = index.post
    place, owner = _spread(off, term)
    keep = np.isin(window[owner] * nb + item[place] // BLOCK, alive)
    n = len(index.items)
    key, inverse = np.unique((window[owner] * n + item[place])[keep], return_inverse=True)
    sums = np.bincount(inverse, weights=gain[place][keep])
    key = key[sums + index.optional[key % n] >= index.threshold]

    best: dict[tuple[int, int], tuple[float, float, float, float]] = {}
    for w, i in zip((key // n).tolist(), (key % n).tolist(), strict=True):
        text = int(np.searchsorted(base, w, side="right")) - 1
        x = begin[text] + (w - base[text]) * index.step
        own_words = h[x : min(x + 2 * index.step, begin[text + 1])]
        terms, gains = index.share[i]
        score = float(gains[np.isin(terms, own_words)].sum())
        if score < index.threshold:
            continue
        size = min(index.words, index.lengths[i])
        found = [(index.whole[i], shingles(own_words, size)), (index.question[i], own_words), (index.answer[i], own_words)]
        over = [float(np.isin(x, y).mean()) for x, y in found]
        leak = over[0] >= index.overlap and (index.as_whole[i] or min(over) >= index.overlap) or over[0] >= HIGH
        if not leak and index.lengths[i] >= 5 and (~np.isin(*found[0])).sum() <= index.words:
            leak = (~np.isin(index.pairs[i], shingles(own_words, 2))).sum() <= 2  # one edit
        if leak:
            best[text, i] = max(best.get((text, i), (0.0,) * 4), (score, *over))
    return [(t, i, *v) for (t, i), v in sorted(best.items())]


def item_rows(items: DataFrame) -> DataFrame:
    """(item_id, text, words, step, known): an item's length in words, its class and its (term, items that have it) pairs; items without words go."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), whole_text().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in steps(whole, "text") if whole.num_rows else ():
                row, h = words_of(b.column("text").to_pylist())
                cut = np.searchsorted(row, np.arange(b.num_rows + 1))
                each = [np.unique(h[x:y]).view(np.int64) for x, y in zip(cut[:-1], cut[1:], strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, each)]).astype(np.int32)), pa.array(np.concatenate(each)))
                n = np.diff(cut).astype(np.int32)
                step = np.array([length_class(x) for x in n.tolist()], np.int32)
                cols = [*b.columns, pa.array(n), pa.array(step), lists]
                yield pa.RecordBatch.from_arrays(cols, names=["item_id", "text", "words", "step", "terms"])

    found = rows.mapInArrow(run, "item_id bigint, text string, words int, step int, terms array<bigint>").filter("words > 0")
    found = materialise(found.withColumn("n", F.monotonically_increasing_id()), "items")
    each = found.select("n", F.explode("terms").alias("term"))
    count = each.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    known = each.join(count, "term").groupBy("n").agg(F.collect_list(F.struct("term", "df")).alias("known"))
    return materialise(found.join(known, "n").select("item_id", "text", "words", "step", "known"), "item-terms")


def indexes(items: DataFrame, block_items: int = INDEX_ITEMS, **options) -> Iterator[Index]:
    """The test items' indexes, ``block_items`` of one length class at a time; the driver holds one block."""
    rows = item_rows(items)
    count, length = rows.agg(F.count(F.lit(1)), F.sum("words")).first()
    part: list = []
    for r in rows.orderBy("step", "item_id", "text").toLocalIterator():
        if part and (len(part) == block_items or r["step"] != part[-1]["step"]):
            yield _built(part, count, length / count, options)
            part = []
        part.append(r)
    if part:
        yield _built(part, count, length / count, options)


def _built(part: list, count: int, mean_len: float, options: dict) -> Index:
    df_of = {x["term"] % 2**64: x["df"] for r in part for x in r["known"]}
    return build([(r["item_id"], r["text"]) for r in part], df_of, count, mean_len, **options)


def passes(spark: SparkSession, items: DataFrame, **options) -> Iterator[list]:
    """Broadcast indexes, in the groups that one pass over the text serves."""
    held: list = []
    for built in indexes(items, **options):
        held.append(spark.sparkContext.broadcast(built))
        if len(held) == PASS_BLOCKS:
            yield held
            held = []
    if held:
        yield held


PAIRS = "doc_id bigint, item_id bigint, score double, overlap double, question_overlap double, answer_overlap double"


def contaminated(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document row and test item found in it: ids, score, overlap, question_overlap, answer_overlap.

    Null or empty texts and items match nothing.  Null ids are reported as
    null; repeated rows (documents or items) are reported each; of several passages with an item the best counts (ties
    are equal in all that is returned); without items or documents the result is empty; other columns are ignored.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("_text"))
    out = spark.createDataFrame([], PAIRS)
    for group in passes(spark, items, **options):

        def run(batches: Iterator[pa.RecordBatch], group=group) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for b in steps(whole, "_text") if whole.num_rows else ():
                    words = words_of(b.column("_text").to_pylist())
                    for shared in group:
                        index = shared.value
                        found = search(index, *words, b.num_rows)
                        if found:
                            text, item, *scores = (list(x) for x in zip(*found, strict=True))
                            ids = pa.array([index.items[i] for i in item], pa.int64())
                            cols = [b.column("doc_id").take(pa.array(text)), ids, *map(pa.array, scores)]
                            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in PAIRS.split(", ")])

        out = out.unionByName(rows.mapInArrow(run, PAIRS))
    return out


def decontaminate(df: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` in which no test item is found, with all their columns.

    Rows are judged each on its own text: repeated rows, and rows with null ids, stay or go alike.  Null or empty
    texts stay, null or empty items find nothing; without items all rows stay; an empty table gives no rows.
    """
    spark = df.sparkSession
    schema = df.schema
    for group in passes(spark, items, **options):

        def run(batches: Iterator[pa.RecordBatch], group=group) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for b in steps(whole, text_col) if whole.num_rows else ():
                    words = words_of([t or "" for t in b.column(text_col).to_pylist()])
                    keep = np.ones(b.num_rows, bool)
                    for shared in group:
                        keep[[x[0] for x in search(shared.value, *words, b.num_rows)]] = False
                    yield b.filter(pa.array(keep))

        df = df.mapInArrow(run, schema)
    return df


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op3_decontaminate": op3_decontaminate}
ORACLE_SQL: dict[str, str] = {}
