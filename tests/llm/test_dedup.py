"""Repeats (1), SimHash (2), exact (5) and line (6) dedup against brute force on rows with nulls, ties and repeats."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from figloom.llm import op1_suffix, op2_simhash, op5_exact, op6_lines

SCHEMA = "doc_id long, text string, p int, _id string, key string"


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gämma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]
    sentence = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [sentence(15) for _ in range(4)]
    docs = []
    for i in range(n):
        parts = [sentence(rng.randint(1, 30)) for _ in range(rng.randint(1, 4))]
        if rng.random() < 0.5:
            parts.insert(rng.randint(0, len(parts)), rng.choice(shared))
        docs.append((i, "\n".join(parts)))
    docs += [(n, docs[0][1]), (n + 1, docs[0][1]), (n + 2, docs[1][1].upper()), (n + 3, "a" * 300), (n + 4, "a" * 200)]
    docs += [(n + 5, ""), (n + 6, None), (n + 7, " \n "), (None, docs[2][1]), (5, docs[5][1]), (n + 8, "x" * 49), (n + 9, docs[3][1] * 40)]
    rng.shuffle(docs)
    return docs


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return rows, spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], SCHEMA)


def repeats(rows):
    """Bytes of each row covered by a 50-byte string that starts in a row of a smaller id (null: largest)."""
    order = lambda i: 2**63 - 1 if i is None else i
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            first[w] = min(first.get(w, order(i)), order(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < order(i):
                gone[k : k + 50] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [2, 1000])
def test_repeats(docs, hot):
    rows, df = docs
    got = op1_suffix.remove_repeats(df, group_bytes=256, hot=hot)
    assert sorted((tuple(r) for r in got.collect()), key=str) == repeats(rows)
    assert op1_suffix.remove_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize(("hot", "very_hot"), [(2, 2), (2, 6), (3, 1_000_000)])
def test_repeats_of_hot_anchors(docs, hot, very_hot):
    rows, df = docs
    got = op1_suffix.remove_repeats(df, group_bytes=256, hot=hot, very_hot=very_hot)
    assert sorted((tuple(r) for r in got.collect()), key=str) == repeats(rows)


def test_hot_anchors_send_few_strings():
    """What a group sends of hot anchors is cut in runs of windows, not in single ones (F1: they took most of the time at 6 GB)."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    line = " ".join(word() for _ in range(40))
    texts = [" ".join([*(word() for _ in range(30)), line, *(word() for _ in range(30))]).encode() for _ in range(50)]
    flat, off = np.frombuffer(b"".join([*texts, bytes(64)]), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    _, windows, anchors = (np.concatenate(x) for x in zip(*op1_suffix.anchor_runs(flat, off.astype(np.int64))))
    docs = pa.table({"_id": range(50), "_h": range(50), "_text": pa.array(texts, pa.binary())})
    reply = pa.table({"a": pa.array([b""]), "b": pa.array([op1_suffix.pack48(np.unique(anchors))]), "c": pa.array([b""])})
    sent = op1_suffix._segments(4, True)((pa.scalar(0),), docs, reply).to_pylist()
    strings = sum(len(op1_suffix.expand(r["c"])) // 8 for r in sent if r["kind"] == 2)
    assert 0 < strings < windows.sum() / 4


def test_equal_hashes_do_not_make_strings_equal():
    parts = [bytes([97 + i % 3]) * 48 + bytes([97 + i % 2]) * 17 + b"z" * 48 for i in range(12)]  # the hash sees the ends only
    text = np.frombuffer(b"".join([*parts, bytes(64)]), np.uint8)
    size = np.full(12, 113)
    of, first = op1_suffix.numbered(text, np.arange(12) * 113, size)
    assert all(parts[first[of[i]]] == parts[i] for i in range(12))


@pytest.mark.parametrize("collapse", [True, False])
def test_repeats_by_files(docs, collapse):
    rows, df = docs
    got = op1_suffix.remove_repeats(df, group_bytes=256, files=True, collapse=collapse)
    assert sorted((tuple(r) for r in got.collect()), key=str) == repeats(rows)


def test_suffix_order(tmp_path):
    rng = random.Random(5)
    parts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 60))) for _ in range(80)]
    off = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    owner, length, lcp = op1_suffix.bwt_order(np.frombuffer(b"".join(parts), np.uint8), off)
    found = [parts[o][len(parts[o]) - n :] for o, n in zip(owner, length)]
    assert found == sorted(found) and len(found) == off[-1] + len(parts)

    def common(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    assert all(lcp[i] == common(found[i - 1], found[i]) for i in range(len(parts), len(found)))
    by_files = [op1_suffix.file_order(np.frombuffer(b"".join(parts), np.uint8), off, str(tmp_path), block) for block in (7, 1 << 16)]
    for some in by_files:
        assert all((x[len(parts) :] == y[len(parts) :]).all() for x, y in zip(some, (owner, length, lcp)))
    assert not list(tmp_path.iterdir())


def fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(ids, fps, bits):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, k in enumerate(ids):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return [least.get(find(i)) for i in range(len(fps))]


def test_simhash(docs, spark):
    rows, df = docs
    got = sorted(((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in op2_simhash.simhash_components(df).collect()), key=str)
    fps = [fingerprint(t) for _, t in rows]
    want = classes([i for i, _ in rows], fps, 4)
    assert got == sorted([(i, f, c) for (i, _), f, c in zip(rows, fps, want)], key=str)
    assert op2_simhash.simhash_components(df.limit(0)).count() == 0


def whole(u, **options):
    return op2_simhash.trie_join(u, tuple(np.array([x]) for x in (0, len(u), 0, len(u))), 4, **options)


@pytest.mark.parametrize("count", [1, 10**8, 10**12])
def test_trie_join_finds_all(count):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = [int(b) for b in base]
    for b in base:
        for _ in range(6):
            x = int(b)
            for bit in rng.choice(64, rng.integers(1, 7), replace=False):
                x ^= 1 << int(bit)
            fps.append(x)
    u = np.unique(np.array(fps, np.uint64))
    want = {(int(u[i]), int(u[j])) for i in range(len(u)) for j in range(i + 1, len(u)) if bin(int(u[i]) ^ int(u[j])).count("1") <= 4}
    pairs = [(int(u[a]), int(u[b])) for i, j in whole(u) for a, b in zip(i, j)]
    assert set(pairs) == want and len(pairs) == len(want) > 0
    found, tables = set(), op2_simhash.tables_for(count)
    for t in tables:
        assert sum(w for _, w in t.blocks) == 64
        p = t.permute(u)
        assert (np.bitwise_count(p[1:] ^ p[:-1]) == np.bitwise_count(u[1:] ^ u[:-1])).all()
        back = u[np.argsort(p)]
        for i, j in whole(np.sort(p), lead=t.lead, budget=t.budget):
            found |= {(min(int(back[a]), int(back[b])), max(int(back[a]), int(back[b]))) for a, b in zip(i, j)}
    assert found == want and (len(tables), tables[0].budget) == {1: (3, 1), 10**8: (10, 1), 10**12: (70, 0)}[count]


def test_the_budget_prunes():
    """Of random fingerprints, the descent compares few pairs and prunes the others on the way, in each trie."""
    u = np.unique(np.random.default_rng(5).integers(0, 2**64, 4000, dtype=np.uint64))
    for t in op2_simhash.tables_for(len(u)):
        stats = Counter()
        assert not list(whole(np.sort(t.permute(u)), lead=t.lead, budget=t.budget, stats=stats))
        assert stats["pruned"] > 10_000 and stats["leaf pairs"] < 4000 * 3999 / 2 / 50


def test_cells_and_their_pairs():
    rng = np.random.default_rng(8)
    u = np.sort(np.concatenate([rng.integers(0, 2**64, 3000, dtype=np.uint64), dense_cluster(1000)]))
    top = (u >> np.uint64(48)).astype(np.int64)
    cells = op2_simhash.cells_of(np.bincount(top, minlength=1 << 16), 100)
    of = {}
    for (depth, prefix), c in cells.items():
        for k in np.flatnonzero(top >> (16 - depth) == prefix):
            of[int(k)] = c
    assert sorted(of) == list(range(len(u))) and sorted(of.values()) == [of[k] for k in range(len(u))]
    pairs = op2_simhash.cell_pairs(cells, 1)
    assert len(pairs) == len(set(pairs)) and all(a <= b for a, b in pairs)
    want = {(of[i], of[j]) for i in range(len(u)) for j in (i + np.flatnonzero(np.bitwise_count(top[i:] ^ top[i]) <= 1)).tolist()}
    assert want <= set(pairs)


def dense_cluster(n, seed=6):
    """Distinct fingerprints of a few flipped bits around one centre, sorted."""
    rng = np.random.default_rng(seed)
    centre, out = int(rng.integers(0, 2**63)), set()
    while len(out) < n:
        x = centre
        for bit in rng.choice(64, rng.integers(1, 5), replace=False):
            x ^= 1 << int(bit)
        out.add(x)
    return np.array(sorted(out), np.uint64)


def near_pairs(u, bits):
    return {(i, int(j) + i + 1) for i in range(len(u)) for j in np.flatnonzero(np.bitwise_count(u[i + 1 :] ^ u[i]) <= bits)}


def test_trie_join_of_a_dense_cluster():
    u = dense_cluster(2000)
    got = [np.stack(p, 1) for p in whole(u)]
    found = [tuple(x) for x in np.concatenate(got).tolist()]
    assert len(found) == len(set(found)) and set(found) == near_pairs(u, 4)


def test_components_of_dense_fingerprints(spark, monkeypatch):
    rng = np.random.default_rng(7)
    u = np.unique(np.concatenate([dense_cluster(1500), rng.integers(0, 2**63, 100, dtype=np.uint64)]))
    fps = spark.createDataFrame([(i, int(x)) for i, x in enumerate(u.view(np.int64))], "doc_id long, fp long")
    monkeypatch.setattr(op2_simhash, "fingerprints", lambda df, *_: df)
    got = sorted(tuple(r) for r in op2_simhash.simhash_components(fps).select("doc_id", "component_id").collect())
    forest = op2_simhash.Forest(len(u))
    forest.link(*np.array(sorted(near_pairs(u, 4))).T)
    assert got == list(enumerate(forest.root.tolist()))
    # small cells, so that links cross them
    nodes = fps.select("fp")
    for size in (50, 100_000):
        edges = op2_simhash.links(nodes, len(u), 4, size)
        roots = dict(tuple(r) for r in op2_simhash.components(edges).collect())
        of = {}
        for i, r in enumerate(forest.root.tolist()):
            of.setdefault(r, set()).add(int(u.view(np.int64)[i]))
        for group in of.values():
            assert {roots.get(x, x) for x in group} == {min(group)}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(101, 100)], "a long, b long")
    got = dict(tuple(r) for r in op2_simhash.components(edges).collect())
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact(docs, keep):
    rows, df = docs
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    got = op5_exact.exact_dedup(df, keep=keep, salts=3).collect()
    assert len(got) == len(rows)
    pick = min if keep == "min" else max
    for text, ids in groups.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        mine = [r for r in got if r["text_sha256"] == sha]
        known = [i for i in ids if i is not None]
        best = pick(known) if known else None
        assert sorted(str(r["doc_id"]) for r in mine) == sorted(map(str, ids))
        assert {(r["keep_id"], r["group_size"]) for r in mine} == {(best, len(ids))}
        assert [r["doc_id"] for r in mine if r["kept"]] == [best]
    assert op5_exact.exact_dedup(df.limit(0)).count() == 0


def strip(line):
    return re.sub("[A-Z]", lambda m: m.group().lower(), line.strip(" \t\n\x0b\x0c\r"))


def test_lines(spark):
    common, short = "This Line Is Long Enough To Count As Boilerplate", "short line"
    rows = [(i, f"{short}\nown {i}\n \t{common if i % 2 else common.lower()}\r\n{short}\n{common}") for i in range(1, 9)]
    rows += [(20, None), (21, ""), (22, f"{common}x\n" * 6), (None, common), (8, "other\n" + common), (30, "\n")]
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], SCHEMA)
    holders = {}
    for i, t in rows:
        for k in {strip(x) for x in (t or "").split("\n")}:
            if len(k) >= 40:
                holders.setdefault(k, []).append(-(2**63) if i is None else i)
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        me = -(2**63) if i is None else i
        kept = [x for x in lines if not (len(h := holders.get(strip(x), [])) >= 5 and me != max(h))]
        want.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    for options in ({}, {"piece": 2, "broadcast_keys": 0}):
        got = op6_lines.line_dedup_digest(df, keep="max", **options).drop("keep_runs")
        assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    assert op6_lines.line_dedup_digest(df.limit(0)).count() == 0


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_tells_texts_of_equal_hashes_apart(docs, keep):
    """All hashes and heads agree, every group is cut in pieces: whole texts decide."""
    rows, df = docs
    got = op5_exact.exact_dedup(df, keep=keep, salts=3, piece=1, head=0, tie=lambda t: F.length(t) * 0).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(hashlib.sha256((t or "").encode()).hexdigest(), []).append(i)
    assert len(got) == len(rows)
    for r in got:
        known = [i for i in groups[r["text_sha256"]] if i is not None]
        best = (min if keep == "min" else max)(known) if known else None
        assert (r["keep_id"], r["group_size"]) == (best, len(groups[r["text_sha256"]]))
    assert sum(r["kept"] for r in got) == len(groups)


def test_exact_compares_neighbours_in_one_piece(spark):
    rows = [(i, "same head " * 40 + str(i % 7)) for i in range(700)] + [(None, "x"), (None, "x"), (3, "x"), (3, "x")]
    df = spark.createDataFrame([(i, t, 1, "a", "b") for i, t in rows], "doc_id long, text string, _t int, _run string, _first string")
    for piece in (10, 10_000):
        got = op5_exact.exact_dedup(df, keep="max", piece=piece).collect()
        assert len(got) == 704 and sum(r["kept"] for r in got) == 8
        assert {(r["keep_id"], r["group_size"]) for r in got} == {(693 + k, 100) for k in range(7)} | {(3, 4)}


def test_bitmap_of_a_very_long_text(spark):
    """Linear in lines and runs: 150,000 lines, half of them dropped in runs of one."""
    line = "a line that is long enough to be counted as boilerplate"
    texts = [(i, "\n".join(f"{line} {k}" if k % 2 else f"{i}" for k in range(150_000 if i == 0 else 20_000))) for i in range(6)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in texts], "doc_id long, text string, _k int, n_lines int")
    began = time.time()
    got = {r["doc_id"]: r for r in op6_lines.line_dedup_digest(df, keep="max").collect()}
    assert time.time() - began < 60
    assert got[0]["n_dropped"] == 10_000 and got[5]["n_dropped"] == 0 and got[5]["keep_runs"] is None
    kept = "\n".join(f"{line} {k}" if k % 2 else "0" for k in range(150_000) if k % 2 == 0 or k >= 20_000)
    assert got[0]["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
    assert got[0]["keep_runs"][:4] == [1, 2, 3, 4] and len(got[0]["keep_runs"]) == 20_000
