"""Near copies: documents whose sets of 5-word shingles have a Jaccard similarity of at least 0.8, found without loss.

1. Each text becomes its set of shingle hashes and the SimHash of its shingles where it lies; equal sets are one node.
   Only the set's prefix and mark (3. and 5.) are stored.
2. The trie self-join of ``op2_simhash`` links near fingerprints.  It finds the closest
   copies, and of large groups of them most, but loses pairs at that similarity, so
3. a prefix filter completes it: with each set in one global order (rare shingles first), two sets
   that are near share a shingle among the first n - ceil(0.8 n) + 1 of each.  Only
   those are dealt out.  The order comes from counts in a bounded sample; it changes
   the speed only, never the result.
4. Sets that share a prefix shingle are candidates unless their lengths or the
   shingle's places rule the similarity out.  The first round compares what the trie links, a chain and a
   tree in each group, and all of a large group with its hubs (the sets in which the group's shingle comes
   first have the fewest rare shingles of their own, so what was copied most).  The second round
   compares all candidates that are not linked yet, so a group of near copies does not make all its pairs.
5. Candidates are compared by parity marks first (one or two bits a shingle): two marks never differ in more bits
   than there are shingles in one of the sets only, so no near pair goes.
   The rest are compared over their whole sets, made again from their texts; links join to components as in op2.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, discard, materialise, whole_text
from .op2_simhash import MAX_BITS, components, fingerprint_texts, label, links
from .op3_decontaminate import shingles
from .op10_tokens import steps

WORDS = 5
#: Sets whose shingles are counted for the order, and shingles kept from them.
SAMPLE, COMMON = 20_000, 50_000
#: Postings of a sorted partition that are paired at once (whole groups), and pairs made at once.
CHUNK, PAIRS = 400_000, 2_000_000
#: Bytes of marks compared at once.
MARK_BYTES = 64_000_000
#: So many fingerprints (8 bytes each) are broadcast; beyond, the join is by shuffle.
BROADCAST_ENDS = 500_000
#: Postings from which on a group is large, and its hubs.
LARGE, HUBS = 32, 4


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the text's shingles (ASCII lower case, cut at white space); of fewer words, of all of them."""
    from xxhash import xxh64_intdigest

    ws = text.encode().lower().split()
    return np.unique(shingles(np.fromiter((xxh64_intdigest(w, 42) for w in ws), np.uint64, len(ws)), words))


def parity_mark(hashes: np.ndarray) -> bytes:
    """A bit for each class of hashes, set where the set holds an odd number of them; as many classes as shingles or up to twice that.

    The classes are a power of two, 64 at least, so halves of a mark laid over each other give the next smaller one.
    """
    width = max(64, 1 << (len(hashes) - 1).bit_length()) if len(hashes) else 64
    odd = np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which the marks (rows of bytes) differ, the wider ones folded."""
    while x.shape[1] != y.shape[1]:
        if x.shape[1] < y.shape[1]:
            x, y = y, x
        half = x.shape[1] // 2
        x = x[:, :half] ^ x[:, half:]
    return np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)).sum(1, dtype=np.int64)


def texts_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("_text"))


def sets(rows: DataFrame, each: Callable[[list[np.ndarray], list[str]], dict[str, pa.Array]], schema: str) -> DataFrame:
    """doc_id, fp (it stands for the set) and what ``each`` makes of the sets and the texts of a step of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for whole in batches:
            for b in steps(whole, "_text") if whole.num_rows else ():
                texts = b.column("_text").to_pylist()
                found = [shingle_set(t) for t in texts]
                fp = np.array([xxh64_intdigest(x.tobytes(), 42) for x in found], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "fp": pa.array(fp), **each(found, texts)})

    return rows.mapInArrow(run, f"doc_id bigint, fp bigint, {schema}")


def lists(each: list[np.ndarray]) -> pa.Array:
    cut = np.cumsum([0, *map(len, each)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(each).view(np.int64)))


def whole_sets(rows: DataFrame) -> DataFrame:
    """(doc_id, fp, hashes)."""
    return sets(rows, lambda found, _: {"hashes": lists(found)}, "hashes array<bigint>")


def common_shingles(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of several texts in a sample, sorted, and their counts."""
    part = rows.filter(F.pmod(F.xxhash64("_text"), F.lit(max(1, rows.count() // SAMPLE))) == 0)
    seen = whole_sets(part).select(F.explode("hashes").alias("h")).groupBy("h").count().filter("count > 2")
    top = seen.orderBy(F.desc("count"), "h").limit(COMMON).toArrow()
    h, n = top.column("h").to_numpy().view(np.uint64), top.column("count").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def sketches(rows: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, fp, sim, n, mark, lead): SimHash, size and mark of each set, and its prefix in the global order.

    Of a set nothing else is stored: those that have a partner are made again from their texts.
    """
    shared = rows.sparkSession.sparkContext.broadcast(common)

    def prefix(h: np.ndarray) -> np.ndarray:
        known, often = shared.value
        rank = np.zeros(len(h), np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            rank = np.where(known[at] == h, often[at], 0)
        keep = len(h) - (4 * len(h) + 4) // 5 + 1
        return h[np.argsort(rank, kind="stable")[:keep]]  # equal ranks by hash

    def each(found: list[np.ndarray], texts: list[str]) -> dict[str, pa.Array]:
        return {
            "sim": pa.array(fingerprint_texts(texts, WORDS).view(np.int64)),
            "n": pa.array([len(x) for x in found], pa.int32()),
            "mark": pa.array([parity_mark(x) for x in found], pa.binary()),
            "lead": lists([prefix(x) for x in found]),
        }

    return sets(rows, each, "sim bigint, n int, mark binary, lead array<bigint>")


def postings(distinct: DataFrame) -> DataFrame:
    """(h, n, fp, at): the prefix shingles of each set, its size and their places in its order."""
    return distinct.select("fp", "n", F.posexplode("lead").alias("at", "h")).select("h", "n", "fp", "at")


def in_groups(df: DataFrame, run: Callable[..., Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``run`` over the columns of whole groups of ``h``, in order of ``h`` and ``n``."""
    names = df.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        for b in batches:
            held.append([b.column(k).to_numpy() for k in names])
            rows += b.num_rows
            if rows >= CHUNK:
                cols = [np.concatenate(x) for x in zip(*held, strict=True)]
                last = np.flatnonzero(cols[0] != cols[0][-1])
                cut = int(last[-1]) + 1 if len(last) else 0  # the last group may go on
                if cut:
                    yield from run(*[x[:cut] for x in cols])
                held, rows = [[x[cut:] for x in cols]], rows - cut
        if rows:
            yield from run(*[np.concatenate(x) for x in zip(*held, strict=True)])

    return df.repartition("h").sortWithinPartitions("h", "n", "fp").mapInArrow(each, schema)


def _expand(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs of the ranges [a0, a1) x [b0, b1)."""
    nb = b1 - b0
    n = (a1 - a0) * nb
    owner = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    return a0[owner] + k // nb[owner], b0[owner] + k % nb[owner]


def _starts(h: np.ndarray) -> np.ndarray:
    """For each row the first row of its group."""
    new = np.concatenate([[True], h[1:] != h[:-1]])
    return np.flatnonzero(new)[np.cumsum(new) - 1]


def shared_postings(found: DataFrame) -> DataFrame:
    """The postings of groups of two sets or more, each once."""

    def run(h, n, fp, at):
        once = np.concatenate([[True], (h[1:] != h[:-1]) | (fp[1:] != fp[:-1])])
        h, n, fp, at = h[once], n[once], fp[once], at[once]
        again = np.concatenate([[False], h[1:] == h[:-1]])
        keep = again | np.append(again[1:], False)
        if keep.any():
            cols = [pa.array(x[keep]) for x in (h, n, fp, at)]
            yield pa.RecordBatch.from_arrays(cols, names=["h", "n", "fp", "at"])

    return in_groups(found, run, "h bigint, n int, fp bigint, at int")


def _pairs(i: np.ndarray, j: np.ndarray, n: np.ndarray, fp: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(a, b) of the rows i and j whose sizes and places allow a similarity of 0.8.

    In the group of the first shingle that two sets share they have nothing in common before it, so the rest bounds
    what they share.  A pair that is ruled out by this in a later group has had its first one.
    """
    left = n.astype(np.int64) - at
    most = np.minimum(left[i], left[j])
    keep = (9 * most >= 4 * (n[i] + n[j])) & (fp[i] != fp[j])
    if keep.any():
        x, y = fp[i[keep]], fp[j[keep]]
        pairs = np.unique(np.stack([np.maximum(x, y), np.minimum(x, y)], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def trie_candidates(distinct: DataFrame) -> DataFrame:
    """(a, b), a > b: sets of one SimHash with one of them, and one set each of linked SimHashes."""
    each = distinct.select("fp", "sim")
    nodes = materialise(each.groupBy("sim").agg(F.min("fp").alias("rep")), "simhashes")
    same = each.join(nodes, "sim").select("fp", "rep")
    near = links(nodes.select(F.col("sim").alias("fp")), nodes.count(), MAX_BITS)
    x, y = (nodes.select(F.col("sim").alias(k), F.col("rep").alias(f"_{k}")) for k in ("a", "b"))
    near = near.join(x, "a").join(y, "b").select(F.col("_a").alias("fp"), F.col("_b").alias("rep"))
    both = same.unionByName(near).filter("fp <> rep")
    return both.select(F.greatest("fp", "rep").alias("a"), F.least("fp", "rep").alias("b")).distinct()


def first_candidates(posted: DataFrame) -> DataFrame:
    """(a, b), a > b: each posting with the one before it, with its parent in a binary tree over its group, and with a large group's hubs."""

    def run(h, n, fp, at):
        first, k = _starts(h), np.arange(len(h))
        inner = k > first
        i = [k[inner] - 1, first[inner] + (k - first - 1)[inner] // 2]
        j = [k[inner], k[inner]]
        size = np.bincount(first, minlength=len(h))
        by_place = np.lexsort((fp, at, first))  # each group's rows stay together
        for hub in range(HUBS):
            large = size[first] >= LARGE
            i.append(by_place[first[large] + hub])
            j.append(k[large])
        yield from _pairs(np.concatenate(i), np.concatenate(j), n, fp, at)

    return in_groups(posted, run, "a bigint, b bigint").distinct()


def other_candidates(posted: DataFrame) -> DataFrame:
    """(a, b), a > b: all pairs of postings (with ``root``) in a group whose roots differ."""

    def run(h, n, fp, at, root):
        k, first = np.arange(len(h)), _starts(h)
        # a row's partners: the rows after it of its group up to 5/4 of its size
        stop = np.searchsorted(first * (1 << 32) + n, first * (1 << 32) + n.astype(np.int64) * 5 // 4, side="right")
        # a group of one root has none
        mixed = np.zeros(len(h), bool)
        mixed[first[root != root[first]]] = True
        k = k[mixed[first] & (stop > k + 1)]
        part = np.cumsum(stop[k] - k) // PAIRS
        for p in np.unique(part):
            own = k[part == p]
            i, j = _expand(own, own + 1, own + 1, stop[own])
            apart = root[i] != root[j]
            yield from _pairs(i[apart], j[apart], n, fp, at)

    return in_groups(posted, run, "a bigint, b bigint").distinct()


def possible(pairs: DataFrame, distinct: DataFrame) -> DataFrame:
    """The candidates whose marks and sizes do not rule out a similarity of 0.8 (at least (n + m) / 9 shingles are then in one set only)."""
    marks = distinct.select("fp", "n", "mark")
    x, y = (marks.select(F.col("fp").alias(k), F.col("n").alias(f"n{k}"), F.col("mark").alias(f"m{k}")) for k in ("a", "b"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "ma", "mb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("na").to_numpy().astype(np.int64) + batch.column("nb").to_numpy()
            marks = [batch.column(k) for k in ("ma", "mb")]
            wide = [np.diff(np.frombuffer(m.buffers()[1], np.int32)[m.offset : m.offset + len(m) + 1]) for m in marks]
            keep = np.zeros(len(n), bool)
            for w in np.unique(np.stack(wide, 1), axis=0):
                at = np.flatnonzero((wide[0] == w[0]) & (wide[1] == w[1]))
                for part in np.array_split(at, 1 + len(at) * int(w.max()) // MARK_BYTES):
                    bits = [np.frombuffer(b"".join(m.take(pa.array(part)).to_pylist()), np.uint8).reshape(-1, k) for m, k in zip(marks, w, strict=True)]
                    keep[part] = 9 * least_apart(*bits) <= n[part]
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep)) for k in ("a", "b")], names=["a", "b"])

    return both.mapInArrow(run, "a bigint, b bigint")


def near(candidates: DataFrame, distinct: DataFrame, nodes: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """The candidates whose whole sets have a similarity of at least 0.8, as a table; the sets are made from the texts of those left by their marks."""
    pairs = materialise(possible(candidates, distinct), name)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    ends = materialise(ends.join(nodes, "fp").select("fp", F.coalesce("rep", F.lit(NULL_ID)).alias("_end")), f"{name}-ends")
    small = ends.count() <= BROADCAST_ENDS  # then no text moves that has no candidate
    texts = rows.join(F.broadcast(ends) if small else ends.hint("shuffle_hash"), F.coalesce("doc_id", F.lit(NULL_ID)) == F.col("_end"), "left_semi")
    own = whole_sets(texts).join(F.broadcast(ends) if small else ends, "fp", "left_semi").select("fp", "hashes").dropDuplicates(["fp"])
    own = materialise(own, f"{name}-sets")
    x, y = (own.select(F.col("fp").alias(k), F.col("hashes").alias(f"_{k}")) for k in ("a", "b"))
    both = pairs.join(x, "a").join(y, "b").withColumn("o", F.size(F.array_intersect("_a", "_b")))
    out = materialise(both.filter(9 * F.col("o") >= 4 * (F.size("_a") + F.size("_b"))).select("a", "b"), f"{name}-links")
    for table in (pairs, ends, own):
        discard(table)
    return out


def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fp (of its set), component_id (smallest id that is near it over any chain).

    A null text counts as empty; texts without words are equal.  Null ids rank
    last.  Repeated rows each give a row.  An empty table gives no rows.
    """
    rows = texts_of(df, id_col, text_col)
    found = materialise(sketches(rows, common_shingles(rows)), "sketches")
    distinct = materialise(found.drop("doc_id").dropDuplicates(["fp"]), "sets")
    ids = materialise(found.select("doc_id", "fp"), "set-ids")
    discard(found)
    nodes = materialise(ids.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    posted = materialise(shared_postings(postings(distinct)), "postings")
    first = first_candidates(posted).unionByName(trie_candidates(distinct)).distinct()
    linked = near(first, distinct, nodes, rows, "pairs")
    roots = components(linked)
    rooted = posted.join(roots, posted["fp"] == roots["node"], "left")
    rooted = rooted.select("h", "n", "fp", "at", F.coalesce("root", "fp").alias("root"))
    linked = linked.unionByName(near(other_candidates(rooted), distinct, nodes, rows, "more-pairs"))
    out = materialise(label(ids, nodes, linked), "near-components")
    for table in (distinct, ids, posted):
        discard(table)
    return out
