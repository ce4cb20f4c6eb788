"""Packing (9) and token files (10) against the tokenizers library, and the pipeline."""

import random
import zlib

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

import corpus_pipeline
from figloom.llm import near_copies
from figloom.llm import op9_packing as B
from figloom.llm import op10_tokens as T
from figloom.llm.fast_tokens import FastEncoder
from figloom.llm.near_copies import near_components
from figloom.llm.op2_simhash import fingerprint_texts

EDGE = ["", "'s", "foo's bar", "\"'s 're", "a  b", "a \n b", "  lead", "trail  ", "\n\n x", "12ab'LL 'll34", "ΑΣ ΣΑ Σ", "é É", "'''s", "日本語 123",
        " x \u3000y", "\t\tq", "I'll we've", "' s", "a\x00b", "½ ²", "🙂🙂a", "x" * 3000, " " * 500, "İ", "<|endoftext|> x", "a<|endoftext|>b <|startoftext|>", "<|ENDOFTEXT|>", "x" * 150 + "yx" * 80, "a\x1cb\x85c"]


def reference(name):
    return Tokenizer.from_file(path(name))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder(name):
    g = random.Random(1)
    texts = EDGE + ["".join(g.choice(" \n\t'sdtmrevl a1.é<|>") for _ in range(g.randint(0, 40))) for _ in range(2000)]
    ids, counts = FastEncoder(path(name)).encode(texts)
    ends = np.cumsum(counts)
    for t, e, n, want in zip(texts, ends, counts, reference(name).encode_batch(texts, add_special_tokens=False)):
        assert ids[e - n : e].tolist() == want.ids, t[:60]


@pytest.fixture(scope="module")
def docs(spark):
    g = random.Random(2)
    rows = [(i, " ".join(g.choice(["one", "two", "three", "Fourth!"]) for _ in range(g.choice([0, 3, 50, 900, 5000])))) for i in range(60)]
    rows += [(70, None), (71, ""), (None, "no id"), (3, "same id"), (3, "same id"), (-5, "negative")] + [(80 + i, t) for i, t in enumerate(EDGE)]
    g.shuffle(rows)
    return rows, spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, part int, ids int").repartition(5)


def test_token_files(spark, docs, tmp_path):
    rows, df = docs
    order = sorted(rows, key=lambda r: (-(2**70) if r[0] is None else r[0], r[1] or ""))
    enc = reference("byte_bpe_50k.json").encode_batch([t or "" for _, t in order], add_special_tokens=False)
    want, at = [], 0
    for (i, _), e in zip(order, enc):
        ids = np.array([*e.ids, 0], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    for encoding in ("dictionary", "delta"):
        out = str(tmp_path / encoding)
        T.write_tokens(df, out, encoding=encoding)
        got = T.token_digest(T.read_tokens(spark, out)).collect()
        assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    meta = T.read_tokens(spark, out, ["doc_id", "start"])
    assert "ids" not in meta._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1][:120]
    T.write_tokens(df.limit(0), str(tmp_path / "none"))
    assert T.read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_packing(docs):
    rows, df = docs
    got = B.pack(df).collect()
    enc = reference("word_bpe_49k.json").encode_batch([t or "" for _, t in rows], add_special_tokens=False)
    want = []
    for (i, _), e in zip(rows, enc):
        ids = np.array([*e.ids, 1], "<u4")
        want += [(i, p // 4096, p, len(ids[p : p + 4096]), zlib.crc32(ids[p : p + 4096].tobytes())) for p in range(0, len(ids), 4096)]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 4096
    assert len(bins) <= sum(w[3] for w in want) / 4096 * 1.02 + 2
    assert B.pack(df.limit(0)).count() == 0


def test_sum_of_squares_by_hand():
    where, offset = B.sum_of_squares(np.array([6, 4, 5, 5, 10, 3]), 10)
    assert where.tolist() == [0, 0, 1, 1, 2, 3] and offset.tolist() == [0, 6, 0, 5, 0, 0]
    g = np.random.default_rng(3)
    sizes = g.integers(1, 65, 300)
    where, offset = B.sum_of_squares(sizes, 64)
    count, fill = np.zeros(65, int), {}
    for s, b in zip(sizes, where):  # each choice was a best one
        cost = {}
        for old in [*{64 - f for f in fill.values() if f < 64}, 64]:
            if old < s or (old < 64 and not count[old]):
                continue
            c = count.copy()
            c[old] -= old < 64
            c[old - s] += old - s > 0
            cost[old] = int((c[1:] ** 2).sum())
        gap = 64 - fill.get(b, 0)
        assert cost[gap] == min(cost.values())
        count[gap] -= gap < 64
        fill[b] = fill.get(b, 0) + s
        count[64 - fill[b]] += fill[b] < 64


def test_pipeline(spark, tmp_path):
    g = random.Random(9)
    words = ["".join(g.choice("abcdefghij") for _ in range(g.randint(2, 7))) for _ in range(600)]
    text = lambda n: " ".join(g.choice(words) for _ in range(n))
    item = text(30) + "."
    rows = [(i, ("vileness " if i % 4 == 0 else "") + text(60)) for i in range(400)]
    labels = [(i, int(i % 4 == 0)) for i in range(400)]
    clean = {i for i in range(400) if i % 4}
    near = rows[2][1] + " " + words[0]  # one more shingle: near, and of a larger id
    planted = [(1000, rows[1][1]), (1001, "vileness " + text(50)), (1002, f"{text(40)} {item} {text(40)}"), (None, text(50)), (1003, None)]
    planted += [(1004, near), (None, rows[3][1]), (1000, rows[1][1]), (1005, "\n")]
    # columns whose names the stages' own ones could clash with
    clash = ["_id", "_sha", "_h", "score", "predicted", "held_out", "_score", "_row_text", "row", "id", "sha", "fp", "component_id", "_text", "_t"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in clash)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *[f"{c}{i}" for c in clash]) for i, t in rows + planted], schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "decontamination", "packing"]
    got = [r[0] for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()]
    # of the equal texts 1 and 1000 the larger id stays, once; of the near ones 2 and 1004 the smaller; the null id loses to 3
    # the null text is equal to none in the second stage, but near to the one without words in the third
    assert len(got) == len(set(got)) and set(got) == (clean - {1}) | {1000, None, 1003}
    # each stage on its own input: its decisions and the other columns
    gone = [{i for i in range(400) if i % 4 == 0} | {1001}, {1}, {1000, 1004, 1005}, {1002}]
    for (name, stage), away in zip(corpus_pipeline.STAGES[:-1], gone):
        out = stage(spark, docs, str(tmp_path))
        found = out.collect()
        assert out.columns == docs.columns and all(r[c] == f"{c}{r['doc_id']}" for r in found for c in clash), name
        assert {r["doc_id"] for r in found} == {i for i, _ in rows + planted} - away, name
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, str(tmp_path))
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_near_copies(spark):
    g = random.Random(12)
    word = lambda: "".join(g.choice("abcdefghij") for _ in range(g.randint(2, 7)))
    passage = [word() for _ in range(60)]
    texts = [None, "", " \n", "a b", "A  b", "a b c", "a b c d e", "a b c d e f"]
    for k in range(50):
        base = [word() for _ in range(g.randint(5, 150))] + (passage if k % 3 == 0 else [])
        texts.append(" ".join(base))
        for _ in range(g.randint(0, 6)):
            other = list(base)
            for _ in range(g.randint(0, 1 + len(base) // 25)):
                other[g.randrange(len(other))] = word()
            texts.append(" ".join(other))
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    root = list(range(len(texts)))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for i, j in pairs:
        a, b = root[i], root[j]
        root = [min(a, b) if r in (a, b) else r for r in root]
    far = sum(bin(int(a) ^ int(b)).count("1") > 4 for a, b in (fingerprint_texts([texts[i] or "", texts[j] or ""]) for i, j in pairs))
    assert far > 20
    rows = list(enumerate(texts))
    g.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in near_components(df).collect()) == list(enumerate(root))
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()}
    assert kept == {i for i, r in enumerate(root) if i == r}


def test_near_copies_when_too_many_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BROADCAST_ENDS", 0)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base), " ".join([*base[:-1], "other"]), " ".join(base[30:]), " ".join(base)]
    # a repeated id with another text, and null ids
    rows = [*enumerate(texts), (1, "something else"), (None, " ".join([*base, "more"])), (None, "alone here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in near_components(df).collect())
    assert got == sorted([("0", "0"), ("1", "0"), ("2", "2"), ("3", "0"), ("1", "1"), ("None", "0"), ("None", "None")])


def test_marks_never_rule_out_a_near_pair():
    rng = np.random.default_rng(3)
    gone = 0
    for _ in range(400):
        n = int(rng.integers(0, 700))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        cut, new = int(rng.integers(0, len(a) + 1)), int(rng.integers(0, 300))
        b = np.unique(np.concatenate([a[:cut], rng.integers(0, 2**63, new, dtype=np.uint64)]))
        apart = len(np.setxor1d(a, b))
        x, y = (np.frombuffer(near_copies.parity_mark(s), np.uint8).reshape(1, -1) for s in (a, b))
        least = int(near_copies.least_apart(x, y)[0])
        assert least <= apart and least == int(near_copies.least_apart(y, x)[0])
        gone += 9 * least > len(a) + len(b)
        assert 9 * least <= len(a) + len(b) or 9 * apart > len(a) + len(b)
    assert gone > 100
