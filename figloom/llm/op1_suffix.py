"""Removal of repeated 50-byte strings by column-wise suffix sorting of a collection.

A window (50 bytes) is repeated if it also starts in a document of a smaller
id.  Equal windows have the same anchor: the least hash among the 24-byte
strings inside.  Consecutive windows of one anchor form a segment, at most a
few more bytes than 50, and a segment's windows can only repeat in segments of
the same anchor.  So the corpus splits in small collections of short
strings, one per anchor, and each collection is sorted exactly.

1. ``anchors``: documents are dealt to groups; each group reports the hash of
   every anchor once, however many of its documents have it.
2. ``shared``: anchors of two groups, or of two documents in one, are sent back to
   the groups that have them.  Others occur once, their text never moves.
3. ``segments``: a group sends the distinct segments of shared anchors, each
   with its smallest id; further copies in the group are marked on the spot.  An
   anchor of many documents is hot: its segments are cut again by the least hash among the
   40-byte strings inside, and dealt by that.  One of very many documents goes as
   single windows dealt by content, so copies collapse and no task gets them all.
4. ``repeats``: equal segments collapse again.  Anchors with several distinct
   segments go through the column-wise construction: in every round one symbol
   of each string, from its end, is inserted, and the collection's
   Burrows-Wheeler transform and its common prefixes are updated in one sequential pass.
   Runs of common prefixes of 50 or more are equal windows; their smallest id
   decides.
5. ``cut``: marks return to the documents' groups, where bytes are removed.

The passes are over arrays in memory: a collection is bounded (``COLLECTION``
strings), and tasks must not write to a machine's own disk.  With ``files`` they are
over sequential files in the shared folder instead (``file_order``), a collection may be of
any size, and with ``collapse=False`` every copy goes through the construction; the result is
the same, at the price that the README gives.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, new_path, whole_text

WINDOW, KMER, INNER = 50, 24, 40
SPAN = WINDOW - KMER + 1
#: Windows of a segment at most, strings sorted in one collection (but for one anchor's), documents that make an anchor hot, and very hot.
RUN, COLLECTION, HOT, VERY_HOT = 64, 2_048, 1_000, 20_000
#: Bytes of text worked on at once, bytes of stored text per group.
CHUNK, GROUP_BYTES = 1 << 20, 4 << 20
ROWS = "key int, p int, kind int, a binary, b binary, c binary, d binary"
NAMES = [c.split()[0] for c in ROWS.split(", ")]
LAST_ID = 2**63 - 1
#: A suffix in a file: the symbol before it, its common prefix with the one before, its length and its string; rows read at once.
SUFFIX = np.dtype([("bwt", "u1"), ("lcp", "u1"), ("length", "u1"), ("owner", "<u4")])
BLOCK = 1 << 16
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def anchor_runs(text: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, windows, 48-bit anchor) of the segments of texts that lie at ``off`` in ``text``, which has 64 spare bytes."""
    total = int(off[-1])
    raw = text.data
    edges = np.concatenate([off[:-1], np.maximum(off[:-1], off[1:] - (WINDOW - 1))])
    edges.sort()
    for lo in range(0, total, CHUNK):
        hi = min(total, lo + CHUNK)
        n = hi - lo + SPAN - 1
        at = lambda k: np.ndarray((n,), "<u8", buffer=raw, offset=lo + k, strides=(1,))  # noqa: B023, E731
        h = at(0) * _C[0] + at(8) * _C[1] + at(16) * _C[2]
        h ^= h >> np.uint64(32)
        h *= _C[3]
        h ^= h >> np.uint64(29)
        width = 1
        while 2 * width <= SPAN:
            h = np.minimum(h[:-width], h[width:])
            width *= 2
        h = np.minimum(h[: hi - lo], h[SPAN - width : SPAN - width + hi - lo])
        inner = edges[np.searchsorted(edges, lo) : np.searchsorted(edges, hi)]
        cut = np.zeros(hi - lo, bool)
        cut[0] = True
        np.not_equal(h[1:], h[:-1], out=cut[1:])
        cut[inner - lo] = True
        start = np.flatnonzero(cut)
        count = np.diff(start, append=hi - lo)
        doc = np.searchsorted(off, start + lo, side="right") - 1
        whole = start + lo + WINDOW <= off[doc + 1]
        start, count = start[whole], count[whole]
        pieces = -(-count // RUN)
        if (pieces > 1).any():
            step = (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * RUN
            start = np.repeat(start, pieces) + step
            count = np.minimum(np.repeat(count, pieces) - step, RUN)
        yield start + lo, count, (h[start] * _C[1]) >> np.uint64(16)


def pack48(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack48(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


@cache
def _zstd() -> tuple:
    from zstandard import ZstdCompressor, ZstdDecompressor

    return ZstdCompressor(3), ZstdDecompressor()


def squeeze(b: bytes) -> bytes:
    return _zstd()[0].compress(b)


def expand(b: bytes) -> bytes:
    return _zstd()[1].decompress(b)


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on, as one number."""
    return np.ndarray((len(text) - 7,), "<u8", buffer=text.data, strides=(1,))


def _mix(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = (h ^ x) * _C[3]
    return h ^ (h >> np.uint64(32))


def content_hash(text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of strings of 50 bytes or more, by their size and their first and last 48 bytes."""
    words, h = _words(text), size.astype(np.uint64) * _C[0]
    for k in range(0, 48, 8):
        h = _mix(_mix(h, words[start + k]), words[start + size - 8 - k])
    return h ^ (h >> np.uint64(29))


def numbered(text: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each string's class, and each class's first string.  Strings of a class are equal, byte by byte; equal
    ones are of one class unless others of the same hash lie between them."""
    words, h = _words(text), content_hash(text, start, size)
    order = np.argsort(h, kind="stable")
    h = h[order]
    a, b = order[1:], order[:-1]
    same = np.flatnonzero((h[1:] == h[:-1]) & (size[a] == size[b]))
    new = np.ones(len(order), bool)
    new[same + 1] = False
    for k in range(0, int(size.max(initial=0)), 8):
        same = same[size[a[same]] > k]
        at = np.minimum(k, size[a[same]] - 8)
        new[same[words[start[a[same]] + at] != words[start[b[same]] + at]] + 1] = True
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return of, order[new]


def inner_runs(text: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, 48-bit hash) of segments cut by the least hash among the 40-byte strings of each window."""
    many = WINDOW - INNER + 1
    words, at = _words(text), spread(start, count + many - 1)
    h = np.zeros(len(at), np.uint64)
    for k in range(0, INNER, 8):
        h = _mix(h, words[at + k])
    h ^= h >> np.uint64(29)
    least = h.copy()
    for k in range(1, many):  # past a segment's last window it is not used
        least[: len(h) - k] = np.minimum(least[: len(h) - k], h[k:])
    own = spread(np.cumsum(count + many - 1) - (count + many - 1), count)
    h, at = least[own], at[own]
    cut = np.ones(len(h), bool)
    cut[1:] = h[1:] != h[:-1]
    cut[np.cumsum(count)[:-1]] = True
    first = np.flatnonzero(cut)
    return at[first], np.diff(first, append=len(h)), (h[first] * _C[1]) >> np.uint64(16)


def _group(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """A group's distinct documents in order of id: flat bytes (with spare), offsets, ids, and each row's document."""
    ids, hashes = t.column("_id").to_pylist(), t.column("_h").to_pylist()
    texts = t.column("_text").to_pylist()
    keys = sorted(set(zip(ids, hashes, strict=True)))
    number = {k: i for i, k in enumerate(keys)}
    owner = [number[k] for k in zip(ids, hashes, strict=True)]
    flat: list[bytes] = [b""] * len(keys)
    for i, x in zip(owner, texts, strict=True):
        flat[i] = x
    off = np.concatenate([[0], np.cumsum([len(x) for x in flat])]).astype(np.int64)
    return np.frombuffer(b"".join([*flat, bytes(64)]), np.uint8), off, np.array([k[0] for k in keys], np.int64), owner


def _rows(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in NAMES]
    types = [pa.int32()] * 3 + [pa.binary()] * 4
    return pa.table([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=NAMES)


def _by_key(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    for part in np.split(order, cuts) if len(order) else ():
        yield int(keys[part[0]]), part


def bwt_order(flat: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes of the strings at ``off`` in order: string number, length, common prefix with the one before.

    Round j inserts, for every string of at least j symbols, its suffix of
    length j.  Its place follows from the rank of its first symbol in the
    transform so far; its common prefix from the least one between that symbol's
    neighbouring occurrences.  No string holds byte 255, which marks the start of a string.
    """
    m = len(off) - 1
    length = np.diff(off)
    end = off[1:]
    bwt = flat[end - 1].copy()
    lcp = np.zeros(m, np.uint8)
    sa = np.arange(m, dtype=np.int64) << 8
    pos = np.arange(m)
    starts = np.zeros(256, np.int64)
    for j in range(1, int(length.max()) + 1):
        live = np.flatnonzero(length >= j)
        p = pos[live]
        c = bwt[p]
        order = np.argsort(bwt, kind="stable")
        inverse = np.empty(len(order), np.int64)
        inverse[order] = np.arange(len(order))
        have = np.bincount(bwt, minlength=256)
        less = np.cumsum(have) - have
        q = inverse[p]
        rank = q - less[c]
        starts += np.bincount(c, minlength=256)
        place = m + (np.cumsum(starts) - starts)[c] + rank
        # common prefixes: of the new ones with those before, and of those after with the new ones
        before, after = rank > 0, rank + 1 < have[c]
        last = order[q[after] + 1]
        a = np.concatenate([order[q[before] - 1], p[after]]) + 1
        b = np.concatenate([p[before], last]) + 1
        down = np.argsort(-a, kind="stable")  # falling starts: nothing is read between two ranges
        ends = np.empty(2 * len(a), np.int64)
        ends[0::2], ends[1::2] = a[down], b[down]
        least = np.empty(len(a), np.int64)
        if len(a):
            least[down] = np.minimum.reduceat(np.append(lcp, np.uint8(255)), ends)[0::2]
        size = len(bwt) + len(live)
        old = np.ones(size, bool)
        old[place] = False
        grown, grown_lcp, grown_sa = np.empty(size, np.uint8), np.empty(size, np.uint8), np.empty(size, np.int64)
        grown[old], grown_lcp[old], grown_sa[old] = bwt, lcp, sa
        grown[place] = np.where(length[live] > j, flat[np.maximum(end[live] - j - 1, 0)], 255)
        grown_sa[place] = live << 8 | j
        grown_lcp[place] = 0
        n = int(before.sum())
        grown_lcp[place[before]] = 1 + least[:n]
        grown_lcp[place[after] + 1] = 1 + least[n:]
        bwt, lcp, sa = grown, grown_lcp, grown_sa
        pos[live] = place
    return sa >> 8, sa & 255, lcp


class _Stored:
    """The suffixes of a file, read in order."""

    def __init__(self, files: pa.fs.FileSystem, path: str):
        self.stream = files.open_input_stream(path)

    def take(self, n: int) -> np.ndarray:
        parts, want = [], n * SUFFIX.itemsize
        while want and (b := self.stream.read(want)):
            parts.append(b)
            want -= len(b)
        return np.frombuffer(b"".join(parts), SUFFIX)


def _ranks(old: _Stored, size: int, p: np.ndarray, block: int) -> tuple[np.ndarray, ...]:
    """One pass over a file of ``size`` suffixes.  Of those at the rising places ``p``: the symbol before each, its rank among equal
    ones, and the common prefixes of what it becomes with its neighbours (-1: it has none)."""
    c, rank = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
    before, after = np.full(len(p), -1, np.int16), np.full(len(p), -1, np.int16)
    # of each symbol: occurrences so far, which of ``p`` the last one is, least common prefix since then
    have, held, since = np.zeros(256, np.int64), np.full(256, -1), np.full(256, 255, np.uint8)
    at = k = 0
    while at < size:
        rows = old.take(min(block, size - at))
        n, lcp = len(rows), np.ascontiguousarray(rows["lcp"])
        stop = int(np.searchsorted(p, at + n))
        own = np.full(n, -1)
        own[p[k:stop] - at] = np.arange(k, stop)
        order = np.argsort(rows["bwt"], kind="stable")
        symbol, own = rows["bwt"][order], own[order]
        new = np.concatenate([[True], symbol[1:] != symbol[:-1]])
        first = np.flatnonzero(new)
        last = np.append(first[1:], n) - 1
        place = have[symbol] + np.arange(n) - np.repeat(first, last - first + 1)
        prior = np.where(new, held[symbol], np.concatenate([[-1], own[:-1]]))
        least = np.minimum(since[symbol], np.minimum.accumulate(lcp)[order])  # right for the first of its symbol here
        inner = np.flatnonzero(~new & ((own >= 0) | (prior >= 0)))
        if len(inner):
            inner = inner[np.argsort(-order[inner - 1], kind="stable")]  # falling starts: nothing is read between two ranges
            ends = np.empty(2 * len(inner), np.int64)
            ends[0::2], ends[1::2] = order[inner - 1] + 1, order[inner] + 1
            least[inner] = np.minimum.reduceat(np.append(lcp, np.uint8(255)), ends)[0::2]
        mine, follows = own >= 0, (prior >= 0) & (place > 0)
        c[own[mine]], rank[own[mine]] = symbol[mine], place[mine]
        mine &= place > 0
        before[own[mine]] = least[mine].astype(np.int16) + 1
        after[prior[follows]] = least[follows].astype(np.int16) + 1
        rest = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.uint8(255))
        since = np.minimum(since, rest[0])
        since[symbol[first]] = rest[order[last] + 1]
        held[symbol[first]] = own[last]
        have[symbol[first]] += last - first + 1
        at, k = at + n, stop
    return c, rank, before, after


def _merge(old: _Stored, out: pa.NativeFile, size: int, place: np.ndarray, fresh: np.ndarray, after: np.ndarray, block: int) -> None:
    """One pass that writes ``size`` suffixes: the ``fresh`` ones at their rising places, the old ones between, common prefixes behind fresh ones as ``after``."""
    changed = np.flatnonzero(after >= 0)
    behind, value = place[changed] + 1, after[changed]
    for at in range(0, size, block):
        n = min(block, size - at)
        k, stop = np.searchsorted(place, [at, at + n])
        rows, kept = np.empty(n, SUFFIX), np.ones(n, bool)
        kept[place[k:stop] - at] = False
        rows[kept] = old.take(n - (stop - k))
        rows[~kept] = fresh[k:stop]
        x, y = np.searchsorted(behind, [at, at + n])
        rows["lcp"][behind[x:y] - at] = value[x:y]
        out.write(rows.tobytes())


def file_order(flat: np.ndarray, off: np.ndarray, folder: str, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``bwt_order``, with the transform and the common prefixes in a sequential file.

    A round reads the file once for ranks and common prefixes, and once to write the next one.  In memory are
    a block of rows and each string's place.  The files are deleted at the end, those of a lost executor with ``folder``.
    """
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    now, then = (f"{root}/{uuid.uuid4().hex}" for _ in range(2))
    m, length, end = len(off) - 1, np.diff(off), off[1:]
    rows = np.zeros(m, SUFFIX)
    rows["bwt"], rows["owner"] = flat[end - 1], np.arange(m)
    with files.open_output_stream(now) as out:
        out.write(rows.tobytes())
    pos, starts, size = np.arange(m), np.zeros(256, np.int64), m
    for j in range(1, int(length.max()) + 1):
        live = np.flatnonzero(length >= j)
        live = live[np.argsort(pos[live])]
        old = _Stored(files, now)
        c, rank, before, after = _ranks(old, size, pos[live], block)
        old.stream.close()
        starts += np.bincount(c, minlength=256)
        place = m + (np.cumsum(starts) - starts)[c] + rank
        pos[live] = place
        by = np.argsort(place)
        live, place, before, after = live[by], place[by], before[by], after[by]
        rows = np.zeros(len(live), SUFFIX)
        rows["bwt"] = np.where(length[live] > j, flat[np.maximum(end[live] - j - 1, 0)], 255)
        rows["lcp"], rows["length"], rows["owner"] = np.maximum(before, 0), j, live
        size += len(live)
        old = _Stored(files, now)
        with files.open_output_stream(then) as out:
            _merge(old, out, size, place, rows, after, block)
        old.stream.close()
        now, then = then, now
    old = _Stored(files, now)
    rows = old.take(size)
    old.stream.close()
    for path in (now, then):
        files.delete_file(path)
    return rows["owner"].astype(np.int64), rows["length"].astype(np.int64), rows["lcp"].copy()


def smallest_owner(segments: list[bytes], ids: np.ndarray, folder: str | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """For each segment, the smallest id over all equal windows, for each of its windows."""
    flat = np.frombuffer(b"".join(segments), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(s) for s in segments])]).astype(np.int64)
    owner, length, lcp = bwt_order(flat, off) if folder is None else file_order(flat, off, folder)
    group = np.cumsum(lcp < WINDOW)
    full = length >= WINDOW
    owner, length, group = owner[full], length[full], group[full]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    least = np.minimum.reduceat(ids[owner], first)
    least = np.repeat(least, np.diff(first, append=len(group)))
    window = off[owner + 1] - off[owner] - length
    out = np.empty(len(flat), np.int64)
    out[off[owner] + window] = least
    for i in range(len(segments)):
        yield i, out[off[i] : off[i + 1] - WINDOW + 1]


def _anchors(buckets: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        text, off, ids, _ = _group(t)
        hashes, docs = [], []
        for start, _, h in anchor_runs(text, off):
            doc = np.searchsorted(off, start, side="right") - 1
            hashes.append(h)
            docs.append(doc)
        if not sum(map(len, hashes)):
            return _rows([])
        h, d = np.concatenate(hashes), np.concatenate(docs)
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
        h = h[new]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        count = np.minimum(np.diff(first, append=len(h)), 2**31 - 1).astype("<u4")
        h = h[first]
        rows = []
        for k, part in _by_key((h % np.uint64(buckets)).astype(np.int64)):
            many = part[count[part] > 1]
            once = part[count[part] == 1]
            # those of one document first, then the others with their counts
            rows.append((k, key[0].as_py(), 0, pack48(h[once]), pack48(h[many]), count[many].tobytes(), None))
        return _rows(rows)

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """The rows of a partition by key; it is sorted by key."""
    now, held = None, []
    for b in batches:
        for r in zip(*[b.column(c).to_pylist() for c in NAMES], strict=True):
            if r[0] != now and held:
                yield now, held
                held = []
            now = r[0]
            held.append(r)
    if held:
        yield now, held


def _shared(batches: Iterator[pa.RecordBatch], hot_from: int, very_hot_from: int) -> Iterator[pa.RecordBatch]:
    for key, rows in _read(batches):
        h, who, count = [], [], []
        for i, r in enumerate(rows):
            one, more = unpack48(r[3]), unpack48(r[4])
            h += [one, more]
            count += [np.ones(len(one), np.int64), np.frombuffer(r[5], "<u4").astype(np.int64)]
            who.append(np.full(len(one) + len(more), i, np.int64))
        h, who, count = np.concatenate(h), np.concatenate(who), np.concatenate(count)
        order = np.argsort(h, kind="stable")
        h, who, count = h[order], who[order], count[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
        total = np.repeat(np.add.reduceat(count, first), np.diff(first, append=len(h))) if len(h) else count
        shared = total > 1
        h, who, total = h[shared], who[shared], total[shared]
        out = []
        for i, part in _by_key(who):
            heat = (total[part] >= hot_from).astype(int) + (total[part] >= max(hot_from, very_hot_from))
            out.append((key, rows[i][1], 1, *[pack48(h[part[heat == x]]) for x in range(3)], None))
        if out:
            yield from _rows(out).to_batches()


def _segments(buckets: int, collapse: bool):
    def run(key: tuple, docs: pa.Table, reply: pa.Table) -> pa.Table:
        if not docs.num_rows or not reply.num_rows:
            return _rows([])
        p = key[0].as_py()
        text, off, ids, _ = _group(docs)
        wanted, hot, very_hot = (np.unique(np.concatenate([unpack48(x) for x in reply.column(c).to_pylist()])) for c in "abc")
        found: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 2)]  # 48-bit hash, start, windows
        for start, count, h in anchor_runs(text, off):
            for some in (wanted, hot, very_hot):
                if not len(some):
                    continue
                at = np.minimum(np.searchsorted(some, h), len(some) - 1)
                hit = some[at] == h
                h_, s, n = h[hit], start[hit], count[hit]
                if not len(s):
                    continue
                if some is hot:
                    s, n, h_ = inner_runs(text, s, n)
                elif some is very_hot:
                    s = spread(s, n)
                    n = np.ones(len(s), np.int64)
                    h_ = content_hash(text, s, n * WINDOW) >> np.uint64(16)
                found.append((h_, s, n))
        return _send(*map(np.concatenate, zip(*found, strict=True)), text, off, ids, p, buckets, collapse)

    return run


def _send(
    head: np.ndarray,
    start: np.ndarray,
    count: np.ndarray,
    text: np.ndarray,
    off: np.ndarray,
    ids: np.ndarray,
    p: int,
    buckets: int,
    collapse: bool = True,
) -> pa.Table:
    """Distinct segments with their smallest id's places, dealt by their hashes, and the marks of the rest."""
    docs = np.searchsorted(off, start, side="right") - 1
    size = count + WINDOW - 1
    # equal segments have one hash; documents come in order of id, so a class's first is its smallest
    of, first = numbered(text, start, size) if collapse else (np.arange(len(start)),) * 2
    best = ids[docs[first]]
    later = best[of] < ids[docs]
    within = start - off[docs]
    keys = (head[first] % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((first, keys))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    first, best, keys = first[order], best[order], keys[order]
    place = np.flatnonzero(~later)
    place = place[np.argsort(rank[of[place]], kind="stable")]
    owner_of = rank[of[place]]
    body = text[spread(start[first], size[first])]
    ends = np.concatenate([[0], np.cumsum(size[first])])
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]]) if len(keys) else [0]
    rows = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        x, y = np.searchsorted(owner_of, [a, b])
        at = place[x:y]
        table = np.stack([owner_of[x:y] - a, docs[at], within[at]]).astype("<u4")
        heading = size[first[a:b]].astype("<u2").tobytes() + pack48(head[first[a:b]])
        parts = (body[ends[a] : ends[b]].tobytes(), heading, best[a:b].astype("<i8").tobytes(), table.tobytes())
        rows.append((int(keys[a]), p, 2, *map(squeeze, parts)))
    if later.any():
        marks = np.stack([docs, within, count])[:, later].astype("<u4")
        rows.append((p % buckets, p, 3, squeeze(marks.tobytes()), None, None, None))
    return _rows(rows)


def _repeats(batches: Iterator[pa.RecordBatch], folder: str | None, collapse: bool) -> Iterator[pa.RecordBatch]:
    for key, rows in _read(batches):
        out: list[tuple] = [(key, r[1], 3, r[3], None, None, None) for r in rows if r[2] == 3]
        bodies, sizes, heads, owners, tables = [], [], [], [], []
        sent = 0
        for r in rows:
            if r[2] == 3:
                continue
            body, heading, owner, places = (expand(x) for x in r[3:7])
            n = len(owner) // 8
            table = np.frombuffer(places, "<u4").reshape(3, -1).astype(np.int64)
            table[0] += sent
            sent += n
            bodies.append(body)
            sizes.append(np.frombuffer(heading, "<u2", n))
            heads.append(unpack48(heading[2 * n :]))
            owners.append(np.frombuffer(owner, "<i8"))
            tables.append(np.concatenate([table, np.full((1, table.shape[1]), r[1])]))
        if sent:
            text = np.frombuffer(b"".join([*bodies, bytes(64)]), np.uint8)
            found = _marks(text, *map(np.concatenate, (sizes, heads, owners)), np.concatenate(tables, 1), folder, collapse)
            for p, part in _by_key(found[3]):
                out.append((key, p, 3, squeeze(found[:3, part].astype("<u4").tobytes()), None, None, None))
        if out:
            yield from _rows(out).to_batches()


def _marks(
    text: np.ndarray, size: np.ndarray, head: np.ndarray, owner: np.ndarray, place: np.ndarray, folder: str | None, collapse: bool
) -> np.ndarray:
    """Document, start, windows and group of the repeated windows of segments that lie one after the other in ``text``.

    ``place`` has the number of a segment (rising), a document and a start in it, and the document's group.
    """
    size = size.astype(np.int64)
    start, count = np.cumsum(size) - size, size - WINDOW + 1
    of, first = numbered(text, start, size) if collapse else (np.arange(len(size)),) * 2
    least = np.full(len(first), LAST_ID)
    np.minimum.at(least, of, owner)
    # collections: whole anchors that have several distinct segments (a lone one equals no other), those of like lengths together
    order = np.argsort(head[first], kind="stable")
    begin = np.flatnonzero(np.concatenate([[True], np.diff(head[first[order]]) != 0]))
    many = np.diff(begin, append=len(order))
    longest = np.maximum.reduceat(size[first[order]], begin)
    own, at, pending = [np.empty(0, np.int64)], np.full(len(first), -1), []
    several = np.flatnonzero(many > 1)
    several = several[np.argsort(longest[several], kind="stable")]
    base = waiting = 0
    for k, i in enumerate(several.tolist()):
        pending.append(order[begin[i] : begin[i] + many[i]])
        waiting += many[i]
        if waiting >= COLLECTION or k + 1 == len(several):
            part = np.concatenate(pending)
            lo, hi = start[first[part]].tolist(), (start + size)[first[part]].tolist()
            segments = [text[a:b].tobytes() for a, b in zip(lo, hi, strict=True)]
            own += [x for _, x in smallest_owner(segments, least[part], folder)]
            n = count[first[part]]
            at[part] = base + np.cumsum(n) - n
            base += int(n.sum())
            pending, waiting = [], 0
    smallest = np.concatenate(own)
    # runs of repeated windows: whole segments, or by the construction
    whole = np.flatnonzero(least[of] < owner)
    some = np.flatnonzero((least[of] >= owner) & (at[of] >= 0))
    hit = smallest[spread(at[of[some]], count[some])] < np.repeat(owner[some], count[some])
    ends = np.cumsum(count[some])
    inside = np.ones(len(hit) + 1, bool)  # no segment begins here
    inside[ends] = inside[:1] = False
    before, after = np.concatenate([[False], hit[:-1]]) & inside[:-1], np.concatenate([hit[1:], [False]]) & inside[1:]
    lo, hi = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after) + 1
    inner = np.searchsorted(ends, lo, side="right")
    segment = np.concatenate([whole, some[inner]])
    shift = np.concatenate([np.zeros(len(whole), np.int64), lo - (ends - count[some])[inner]])
    length = np.concatenate([count[whole], hi - lo])
    x, y = np.searchsorted(place[0], segment), np.searchsorted(place[0], segment, side="right")
    there = place[:, spread(x, y - x)]
    return np.stack([there[1], there[2] + np.repeat(shift, y - x), np.repeat(length, y - x), there[3]])


def _cut(key: tuple, docs: pa.Table, marks: pa.Table) -> pa.Table:
    text, off, ids, owner = _group(docs)
    n = int(off[-1])
    change = np.zeros(n + 1, np.int32)
    for m in marks.column("a").to_pylist() if marks.num_rows else ():
        d, s, w = np.frombuffer(expand(m), "<u4").reshape(3, -1).astype(np.int64)
        np.add.at(change, off[d] + s, 1)
        np.add.at(change, off[d] + s + w + WINDOW - 1, -1)
    gone = np.cumsum(change[:n]) > 0
    count = np.concatenate([[0], np.cumsum(gone)])
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    inner = off[:-1][off[:-1] < n]
    begins[inner] = gone[inner]
    spans = np.concatenate([[0], np.cumsum(begins)])
    out = []
    for i in range(len(off) - 1):
        a, b = int(off[i]), int(off[i + 1])
        whole = text[a:b]
        left = whole[~gone[a:b]] if count[b] > count[a] else whole
        out.append((b - a, int(count[b] - count[a]), int(spans[b] - spans[a]), hashlib.sha256(left).hexdigest()))
    found = list(zip(*[out[i] for i in owner], strict=True)) if owner else [[]] * 4
    cols = [docs.column("doc_id"), *[pa.array(list(c), t) for c, t in zip(found, [pa.int64()] * 3 + [pa.string()], strict=True)]]
    return pa.table(cols, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    group_bytes: int = GROUP_BYTES,
    hot: int = HOT,
    files: bool = False,
    collapse: bool = True,
    very_hot: int = VERY_HOT,
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A null text counts as empty.  A null id ranks after all others.  Rows of one
    id, repeated or not, never mark each other.  Texts under 50 bytes lose
    nothing; an empty table gives no rows.  ``files`` and ``collapse`` change the way, not the result.
    """
    spark = df.sparkSession
    folder = new_path(spark, "suffixes") if files else None
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(shuffle, min(-(-size // group_bytes), 10_000_000))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).cast("binary").alias("_text"))
    rows = rows.withColumn("_id", F.coalesce("doc_id", F.lit(LAST_ID))).withColumn("_h", F.xxhash64("_text"))
    rows = rows.withColumn("p", F.pmod(F.xxhash64("_id", "_h"), F.lit(groups)).cast("int")).repartition("p")

    def dealt(d: DataFrame) -> DataFrame:
        return d.repartition("key").sortWithinPartitions("key")

    found = dealt(rows.groupBy("p").applyInArrow(_anchors(groups), ROWS))
    reply = found.mapInArrow(lambda batches: _shared(batches, hot, very_hot), ROWS)
    sent = rows.groupBy("p").cogroup(reply.groupBy("p")).applyInArrow(_segments(groups, collapse), ROWS)
    marks = dealt(sent).mapInArrow(lambda batches: _repeats(batches, folder, collapse), ROWS)
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return rows.groupBy("p").cogroup(marks.groupBy("p")).applyInArrow(_cut, schema)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
ORACLE_SQL: dict[str, str] = {}
