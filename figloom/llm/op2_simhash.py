"""Near-duplicates by SimHash and a binary-trie self-join.

1. Fingerprints are made where the texts lie.  Equal fingerprints collapse to
   one node with its smallest id (partial aggregation, so copies never meet
   in one task).
2. A binary trie over the fingerprints is joined with itself: pairs of nodes go down
   together, differing bits add up, and a pair over the error budget is pruned.  To prune
   early the join runs over a few tries whose bits are in another order: by the pigeonhole
   principle two linked fingerprints differ in at most one of the first 21 bits in one of three
   tries, so that is the budget there, and the whole budget holds below.  Nothing is lost.
3. The driver knows the trie's top only (counts of DEPTH-bit prefixes).  Its leaves are cells of a
   bounded number of fingerprints (a prefix of DEPTH bits is not cut further); the descent over
   the top gives the pairs of cells that are within the budget, and each pair of cells is one
   unit of work that goes on down to the leaves.  A unit returns a spanning forest (at most one link
   per fingerprint), never all pairs of a group, and does not go into nodes that are one tree already.
4. Components of the links come by alternating large-star and small-star
   steps on tables, each written to the shared folder.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, materialise, whole_text
from .op10_tokens import steps

WORDS = 4
MAX_BITS = 4
#: Bits of the coarse trie, and fingerprints of one of its cells (more where that gives too many cells).
DEPTH, CELL = 16, 8_192
#: Pairs of nodes expanded at once.
FRONTIER = 500_000


def fingerprint_texts(texts: list[str], words: int = WORDS) -> np.ndarray:
    """SimHash of each text: a bit is set if it is in over half of the shingles' XXH64 (seed 42)."""
    from xxhash import xxh64_intdigest

    out = np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts):
        ws = text.encode().lower().split()
        if not ws:
            continue
        joined = b" ".join(ws)
        if len(ws) <= words:
            out[i] = xxh64_intdigest(joined, 42)
            continue
        ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
        first = [0, *(ends[: len(ws) - words] + 1).tolist()]
        h = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(first, ends[words - 1 :].tolist(), strict=True)], "<u8")
        count = np.zeros(64, np.int64)
        for k in range(0, len(h), 65536):
            count += np.unpackbits(h[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[i] = np.packbits(2 * count > len(h), bitorder="little").view("<u8")[0]
    return out


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in steps(whole, "_text") if whole.num_rows else ():
                fp = fingerprint_texts(b.column("_text").to_pylist(), words)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(run, "doc_id bigint, fp bigint")


@dataclass(frozen=True)
class Table:
    """A trie over the fingerprints with their blocks of bits in another order; ``lead`` bits come first."""

    blocks: tuple[tuple[int, int], ...]  # lowest bit and width, the trie's top first
    lead: int
    budget: int  # bits that may differ among the lead

    def permute(self, fp: np.ndarray) -> np.ndarray:
        out, left = np.zeros(len(fp), np.uint64), 64
        for low, width in self.blocks:
            left -= width
            out |= ((fp >> np.uint64(low)) & np.uint64((1 << width) - 1)) << np.uint64(left)
        return out


def tables_for(count: int, max_bits: int = MAX_BITS) -> list[Table]:
    """The tries: any two fingerprints within ``max_bits`` are within the lead's smaller budget in one of them.

    Of B blocks, some e have together at most what the e least have when the bits that differ
    are spread evenly (pigeonhole).  More fingerprints take a longer lead.
    """
    blocks, taken = next(x for x, most in (((3, 1), 25), ((5, 2), 29), ((8, 4), 99)) if count <= 1 << most)
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    block = [(cuts[i], cuts[i + 1] - cuts[i]) for i in range(blocks)]
    each, more = divmod(max_bits, blocks)
    budget = taken * each + max(0, taken - (blocks - more))
    return [
        Table((*chosen, *[x for x in block if x not in chosen]), sum(w for _, w in chosen), budget)
        for chosen in combinations(block, taken)
    ]


def cells_of(count: np.ndarray, size: int) -> dict[tuple[int, int], int]:
    """The coarse trie's leaves (depth, prefix) -> number, in order: nodes of at most ``size`` fingerprints, or of the last depth.

    ``count`` holds how many fingerprints each prefix of DEPTH bits has.
    """
    total = np.concatenate([[0], np.cumsum(count)])
    out: dict[tuple[int, int], int] = {}
    stack = [(0, 0)]
    while stack:
        depth, prefix = stack.pop()
        span = 1 << (DEPTH - depth)
        n = total[(prefix + 1) * span] - total[prefix * span]
        if n and (n <= size or depth == DEPTH):
            out[depth, prefix] = len(out)
        elif n:
            stack += [(depth + 1, 2 * prefix + 1), (depth + 1, 2 * prefix)]
    return out


def cell_pairs(cells: dict[tuple[int, int], int], budget: int) -> list[tuple[int, int]]:
    """The leaves of the coarse trie that the joint descent reaches: pairs (u <= v) within the lead's budget."""
    inner = {(d, p >> (depth - d)) for depth, p in cells for d in range(depth)}
    out = []
    stack = [((0, 0), (0, 0), 0)]
    while stack:
        u, v, err = stack.pop()
        if err > budget or not ((u in inner or u in cells) and (v in inner or v in cells)):
            continue
        if u in cells and v in cells:
            out.append((cells[u], cells[v]))
            continue
        us = [u] if u in cells else [(u[0] + 1, 2 * u[1] + k) for k in (0, 1)]
        vs = [v] if v in cells else [(v[0] + 1, 2 * v[1] + k) for k in (0, 1)]
        for i, x in enumerate(us):
            for j, y in enumerate(vs):
                if u != v or i <= j:
                    stack.append((x, y, err + (len(us) == len(vs) and i != j)))
    return out


def trie_join(
    fp: np.ndarray,
    roots: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray],
    max_bits: int,
    lead: int = 0,
    budget: int = 0,
    joined: Callable[..., np.ndarray] | None = None,
    stats: Counter | None = None,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of sorted distinct fingerprints that differ in at most ``max_bits`` bits, ``budget`` of the first ``lead``.

    ``roots`` are pairs of nodes [a0, a1) and [b0, b1): a node with itself or a lower and a higher one.
    Node pairs go down together, a bit a step; one is pruned when its differing bits exceed the
    budget, or when ``joined`` says that its links are known.  A pair of leaves is compared in the bits that are left.
    """
    zeros: dict[int, np.ndarray] = {}
    stats = Counter() if stats is None else stats

    def middle(bit: int, x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
        if bit not in zeros:
            z = np.zeros(len(fp) + 1, np.int64)
            np.cumsum((fp >> np.uint64(bit)) & np.uint64(1) == 0, out=z[1:])
            zeros[bit] = z
        return x0 + zeros[bit][x1] - zeros[bit][x0]

    # a frame: the next bit, nodes a and b as ranges (equal for a node with itself), bits that differ so far
    stack = [(63, *roots, np.zeros(len(roots[0]), np.int8))]
    while stack:
        bit, a0, a1, b0, b1, err = stack.pop()
        if len(a0) > FRONTIER:
            h = len(a0) // 2
            stack += [(bit, a0[h:], a1[h:], b0[h:], b1[h:], err[h:]), (bit, a0[:h], a1[:h], b0[:h], b1[:h], err[:h])]
            continue
        if joined is not None:
            go = ~joined(a0, a1, b0, b1)
            a0, a1, b0, b1, err = a0[go], a1[go], b0[go], b1[go], err[go]
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaf.any():
            i, j = a0[leaf], b0[leaf]
            stats["leaf pairs"] += len(i)
            near = np.bitwise_count(fp[i] ^ fp[j]) <= max_bits
            if near.any():
                yield i[near], j[near]
            go = ~leaf
            a0, a1, b0, b1, err = a0[go], a1[go], b0[go], b1[go], err[go]
        if not len(a0):
            continue
        stats["node pairs"] += len(a0)
        am, bm, self_ = middle(bit, a0, a1), middle(bit, b0, b1), a0 == b0
        next_ = [
            (a0, am, b0, bm, err, slice(None)),
            (am, a1, bm, b1, err, slice(None)),
            (a0, am, bm, b1, err + 1, slice(None)),
            (am, a1, b0, bm, err + 1, ~self_),  # a stays the lower node
        ]
        frame = [np.concatenate([x[k][x[5]] for x in next_]) for k in range(5)]
        real = (frame[1] > frame[0]) & (frame[3] > frame[2])
        real &= ~((frame[0] == frame[2]) & (frame[1] - frame[0] < 2))
        keep = real & (frame[4] <= (budget if bit >= 64 - lead else max_bits))
        stats["pruned"] += int(real.sum() - keep.sum())
        if keep.any():
            stack.append((bit - 1, *[x[keep] for x in frame]))


class Forest:
    """Each node's least linked node, directly or over others."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.root
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
        self.root = root

    def joined(self, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
        """Whether all of both nodes have one root, so that nothing is left to find between them."""
        change = np.concatenate([[0], np.cumsum(self.root[1:] != self.root[:-1])])
        return (change[a1 - 1] == change[a0]) & (change[b1 - 1] == change[b0]) & (self.root[a0] == self.root[b0])


def spanning(fp: np.ndarray, cut: int, max_bits: int, lead: int, budget: int, stats: Counter | None = None) -> np.ndarray:
    """Roots of sorted distinct fingerprints: the trie with itself, or of those before ``cut`` with the others (0 < cut < len)."""
    found = Forest(len(fp))
    k = np.flatnonzero(np.bitwise_count(fp[1:] ^ fp[:-1]) <= max_bits)
    found.link(k, k + 1)  # a dense cluster is one tree before the descent
    roots = (0, cut, cut, len(fp)) if 0 < cut < len(fp) else (0, len(fp), 0, len(fp))
    for i, j in trie_join(fp, tuple(np.array([x]) for x in roots), max_bits, lead, budget, found.joined, stats):
        found.link(i, j)
    return found.root


def links(nodes: DataFrame, count: int, max_bits: int, size: int | None = None) -> DataFrame:
    """(a, b): links a > b between the distinct fingerprints ``fp`` of ``nodes``, a spanning forest of each pair of cells.

    The coarse trie has at most 2^DEPTH leaves a table, and its counts are all that the driver sees.
    """
    tries = tables_for(count, max_bits)
    size = size or max(CELL, count >> (DEPTH - 2))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(tries), 1 << DEPTH), np.int64)
        for b in batches:
            u = b.column("fp").to_numpy().view(np.uint64)
            for t, table in enumerate(tries):
                seen[t] += np.bincount((table.permute(u) >> np.uint64(64 - DEPTH)).astype(np.int64), minlength=1 << DEPTH)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen.ravel()[at])], names=["at", "n"])

    seen = nodes.select("fp").mapInArrow(prefixes, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    held = np.zeros(len(tries) << DEPTH, np.int64)
    held[seen.column("at").to_numpy()] = seen.column("n").to_numpy()
    cell_at = np.zeros(len(tries) << DEPTH, np.int32)  # the cell of a table's prefix
    frames: list[tuple[int, int, int]] = []  # table, cell, cell
    base = 0
    for t, table in enumerate(tries):
        cells = cells_of(held[t << DEPTH : (t + 1) << DEPTH], size)
        for (depth, prefix), c in cells.items():
            span = 1 << (DEPTH - depth)
            cell_at[(t << DEPTH) + prefix * span : (t << DEPTH) + (prefix + 1) * span] = base + c
        frames += [(t, base + u, base + v) for u, v in cell_pairs(cells, table.budget)]
        base += len(cells)
    if not frames:
        return nodes.sparkSession.createDataFrame([], "a bigint, b bigint")
    of = np.array(frames)
    # each cell's frames in a row
    ends = np.concatenate([of[:, 1], of[of[:, 1] != of[:, 2], 2]])
    frame_of = np.concatenate([np.arange(len(of)), np.flatnonzero(of[:, 1] != of[:, 2])])
    order = np.argsort(ends, kind="stable")
    shared = nodes.sparkSession.sparkContext.broadcast(
        (cell_at, of, frame_of[order].astype(np.int32), np.searchsorted(ends[order], np.arange(base + 1)))
    )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell_at, _, frame_of, off = shared.value
        for b in batches:
            fp = b.column("fp").to_numpy()
            for t, table in enumerate(tries):
                cell = cell_at[(t << DEPTH) + (table.permute(fp.view(np.uint64)) >> np.uint64(64 - DEPTH)).astype(np.int64)]
                n = off[cell + 1] - off[cell]
                own = np.repeat(np.arange(len(fp)), n)
                at = off[cell][own] + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([pa.array(frame_of[at]), pa.array(fp[own])], names=["frame", "fp"])

    def join(key: tuple, rows: pa.Table) -> pa.Table:
        cell_at, of, _, _ = shared.value
        t, u, _ = of[key[0].as_py()]
        table = tries[t]
        plain = rows.column("fp").to_numpy().view(np.uint64)
        fp = table.permute(plain)
        order = np.argsort(fp)
        plain, fp = plain[order].view(np.int64), fp[order]
        cut = int((cell_at[(t << DEPTH) + (fp >> np.uint64(64 - DEPTH)).astype(np.int64)] == u).sum())
        root = spanning(fp, cut, max_bits, table.lead, table.budget)
        child = np.flatnonzero(root != np.arange(len(fp)))
        x, y = plain[child], plain[root[child]]
        return pa.table({"a": np.maximum(x, y), "b": np.minimum(x, y)})

    dealt = nodes.select("fp").mapInArrow(deal, "frame int, fp bigint")
    return dealt.groupBy("frame").applyInArrow(join, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a > b); the root is the component's least node."""

    def least(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"))

    edges = materialise(edges, "links")
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        m = least(both).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(m, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = materialise(large, "large-star")
        discard(edges)
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        m = least(down)
        small = down.join(m, "u").filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(m.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        small = materialise(small, "small-star")
        discard(large)
        tall = small.join(small.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty()
        wide = small.groupBy("a").count().filter("count > 1").isEmpty()
        edges = small
        if tall and wide:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def label(fps: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``fps``; ``nodes`` has each fp's smallest id ``rep``."""
    roots = components(edges)
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left")
    placed = placed.select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_fp = placed.join(ids, "root").select(F.col("fp").alias("_f"), "component_id")
    return fps.join(by_fp, F.col("fp") == F.col("_f")).select("doc_id", "fp", "component_id")


def simhash_components(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """One row per input row: doc_id, fp (signed long), component_id (smallest id linked to it over any chain).

    A null text counts as empty; texts without words have fingerprint zero.
    Null ids rank last: a component of null ids only has a null component_id.
    Repeated rows each give a row.  An empty table gives no rows.
    """
    fps = materialise(fingerprints(df, id_col, text_col, words), "fingerprints")
    nodes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    return label(fps, nodes, links(nodes, nodes.count(), max_bits))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op2_simhash": op2_simhash}
ORACLE_SQL: dict[str, str] = {}
