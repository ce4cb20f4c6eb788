"""Decontamination (3), URL filter (4), personal data (7) and toxicity (8)."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from figloom.llm import op3_decontaminate as D
from figloom.llm import op4_urls as U
from figloom.llm import op7_pii as P
from figloom.llm import op8_toxicity as T

rng = random.Random(11)
WORDS = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]


def passage(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


ITEMS = [(i, f"{passage(15)}? {passage(8)}.") for i in range(40)] + [(40, None), (41, ""), (42, "two words")]


def plain_words(text):
    return re.findall(r"[a-z0-9]+", text.lower())


def plain_search(items, docs):
    """(document, item) pairs by plain loops: BM25 over word lists, windows by an item's own length, then the overlaps."""
    lists = [(i, plain_words(t or ""), t or "") for i, t in items if plain_words(t or "")]
    mean = sum(len(w) for _, w, _ in lists) / len(lists)
    held = Counter(x for _, w, _ in lists for x in set(w))
    runs = lambda w, n: {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))}
    out = set()
    for i, w, t in lists:
        idf = {x: math.log(1 + (len(lists) - held[x] + 0.5) / (held[x] + 0.5)) for x in set(w)}
        gain = {x: idf[x] * w.count(x) * 2.2 / (w.count(x) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x in set(w)}
        q, a = (plain_words(x) for x in D.question_and_answer(t))
        as_whole = "?" not in t or len(set(a)) < 5
        step = 32
        while step < len(w):
            step *= 2
        for n, doc in enumerate(docs):
            words = plain_words(doc)
            for x in range(0, max(len(words) - step, 1), step):
                own = words[x : x + 2 * step]
                if sum(gain[y] for y in set(own) & set(w)) < 0.6 * sum(gain.values()):
                    continue
                mine, theirs = runs(w, 5), runs(own, min(5, len(w)))
                share = len(mine & theirs) / len(mine)
                part = min(len(set(y) & set(own)) / len(set(y)) for y in (q, a))
                edit = len(w) >= 5 and len(mine - theirs) <= 5 and len(runs(w, 2) - runs(own, 2)) <= 2
                if share >= 0.8 and (as_whole or part >= 0.8) or share >= 0.9 or edit:
                    out.add((n, i))
    return out


def test_wand_equals_exhaustive_search():
    docs = []
    for k in range(80):
        item = ITEMS[rng.randrange(40)][1]
        inside = [item, item.upper(), item.split("?")[0], " ".join(rng.sample(item.split(), len(item.split()))), ""][k % 5]
        docs.append(f"{passage(rng.randint(0, 300))} {inside} {passage(rng.randint(0, 300))}")
    docs += ["", "x", ITEMS[3][1], f"{passage(20_000)} {ITEMS[5][1]} {passage(100)}"]
    want = plain_search(ITEMS, docs)
    assert found_in([x for x in ITEMS if x[1]], docs) == want and len(want) > 25 and (83, 5) in want


def test_results_do_not_depend_on_blocks(spark):
    """Short items among one of 900 words, in blocks of one item and of all; statistics are the same."""
    items = [(i, f"{passage(g)}? {passage(8)}.") for i, g in enumerate([15, 12, 20, 40, 70, 900, 16])] + [(7, None), (8, "")]
    spread = items[1][1].split()
    docs = [f"{passage(300)} {t} {passage(300)}" for _, t in items[:7]]
    # a short item's words over 200 foreign ones are no passage of it
    docs += [" ".join(f"{w} {passage(18)}" for w in spread), passage(4000), None, ""]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(docs)], "doc_id long, text string, item_id string, score string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(plain_search(items, [t or "" for t in docs]))
    assert [(i, i) for i in range(7)] == want
    for block in (1, 1000):
        assert sorted((r["doc_id"], r["item_id"]) for r in D.contaminated(df, bench, block_items=block).collect()) == want
        kept = D.decontaminate(df, bench, block_items=block)
        assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [7, 8, 9, 10]


def found_in(items, docs):
    count, length = Counter(), 0
    for _, t in items:
        h = D.words_of([t])[1]
        count.update(np.unique(h).tolist())
        length += len(h)
    index = D.build(items, count, len(items), length / len(items))
    return {(t, index.items[i]) for t, i, *_ in D.query(index, docs)}


def test_one_word_edits_do_not_hide_a_leak():
    shapes = [(15, ". ", 1), (20, ". ", 3), (12, ". ", 12), (14, "? ", 1), (14, "? ", 8), (3, "? ", 20), (40, "? ", 6), (9, ". ", 2)]
    items = [(i, f"{passage(a)}{mark}{passage(b)}.") for i, (a, mark, b) in enumerate(shapes)]
    docs, want = [], set()
    for i, t in items:
        w = t.split()
        for k in range(len(w)):
            end = "?" if w[k].endswith("?") else ""
            for new in (["zzqx" + end], [], ["zzqx", w[k]]):
                if new or not end:  # a question keeps its mark
                    want.add((len(docs), i))
                    docs.append(f"{passage(60)} {' '.join(w[:k] + new + w[k + 1 :])} {passage(60)}")
    clean = len(docs)
    docs += [passage(200), items[4][1].split("?")[0], items[2][1].split(". ")[0], " ".join(sorted(items[1][1].split()))]
    got = found_in(items, docs)
    assert got == want and len(want) > 300 and not [x for x in got if x[0] >= clean]


def test_decontaminate(spark):
    leak = f"{passage(90)} {ITEMS[7][1].upper()} {passage(90)}"
    edited = ITEMS[8][1].split()
    edited[-3] = "changed"
    rows = [(1, leak, "a"), (2, passage(200), "b"), (None, leak, "c"), (3, None, "d"), (3, "", "e"), (4, ITEMS[9][1].split("?")[0], "f"), (5, " ".join(edited), "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for block in (5, 1000):
        found = D.contaminated(df, items, block_items=block)
        assert sorted(((r["doc_id"], r["item_id"]) for r in found.collect()), key=str) == [(1, 7), (5, 8), (None, 7)]
        assert sorted(r["item_id"] for r in D.decontaminate(df, items, block_items=block).collect()) == ["b", "d", "e", "f"]
    assert D.contaminated(df.limit(0), items).count() == 0
    assert D.contaminated(df, items.limit(0)).count() == 0 and D.decontaminate(df, items.limit(0)).count() == 7


def test_urls(spark):
    urls = ["https://WWW.Example.NET/en/x?q", "http://a.net/x", "http://net", "http://anet/x", "http://example.com/de/", "http://example.com/de",
            "http://x.org/fr/1#t", "no url", None, "", "://", "s://h?://x/", "http://bad.test/1", "http://bad.test/2"]
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)] + [(None, urls[0], 1), (0, urls[0], 1)], "page_id long, url string, host int")
    bad = spark.createDataFrame([(12, 1)] * 60 + [(13, 1)] * 60 + [(0, 0)] * 60 + [(1, None), (None, 1)], "page_id long, bad int")
    for size in (0, 1000):
        rows = U.judge_urls(df, bad, broadcast_hosts=size).collect()
        assert len(rows) == 16
        by = {r["page_id"]: r for r in rows}
        got = {i: (by[i]["host"], by[i]["path"], by[i]["rule"], by[i]["verdict"]) for i in range(len(urls))}
        assert got[0] == ("www.example.net", "/en/x", "example.net/en/", "allow")
        assert got[1][2:] == ("net/", "block") and got[2] == ("net", "", None, "allow") and got[3][2] is None
        assert got[4][2:] == ("example.com/de/", "block") and got[5][2] is None and got[6][2:] == ("org/fr/", "allow")
        assert got[7][:2] == got[8][:2] == got[9][:2] == got[10][:2] == ("", "") and got[11][:2] == ("h", "")
        assert got[12][3] == got[13][3] == "block"
    assert U.judge_urls(df, bad.limit(0)).filter("verdict is null").count() == 0
    assert U.judge_urls(df.limit(0), bad).count() == 0


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for k, (name, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": name == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 14 <= len(d) <= 19 and luhn(d),
                "phone": 10 <= len(d) <= 15,
            }[name]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii(spark, tmp_path):
    g = random.Random(4)
    bits = ["4111 1111 1111 1111", "4111-1111-1111-1112", "5500005555555559", "1.2.3.4", "1.2.3.400", "1.2.3.4.5.6.7.8", "a.b@c.de", "a@b@c.d.e_f@g.hi",
            "+49 (30) 1234-5678", "+1", "é", "\n", " ", "--", "12345678901234567890", "GB82WEST12345698765432", "iban GB83WEST12345698765432", "ssn 123-45-6789",
            "123-45-6789", "@", ".", "x", "0", "7 ", "😀"]
    texts = ["".join(g.choice(bits) for _ in range(g.randint(0, 12))) for _ in range(400)]
    texts += [None, "", "1" * 20_000, "a" * 20_000, "1 " * 5_000, "+" * 3_000, "a@" * 3_000, "1." * 3_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in P.op7_pii(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t)
        joined = ",".join(f"{BASE[k][0]}:{s}:{e}" for s, k, e in want)
        r = got[i]
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), (t or "")[:80]
        assert [r[f"n_{n}"] for n, _ in BASE] == [sum(k == j for _, k, _ in want) for j in range(4)]
        kept = [x for x in r["spans"].split(",") if x and x.split(":")[0] in dict(BASE)]
        assert ",".join(kept) == joined
    find = lambda t: P.find_pii(spark.createDataFrame([(1, t)], "doc_id int, text string")).first()["found"]
    assert [(P.KINDS[s["kind"]].name) for s in find("account GB82WEST12345698765432, ssn 123-45-6789")] == ["iban", "ssn"]
    assert find("GB83WEST12345698765432 123-45-6789") == []
    assert P.find_pii(df.limit(0)).count() == 0


def test_toxicity(spark):
    g = random.Random(8)
    bad, group = ["grubby", "grubbish", "grubling"], ["them", "those"]

    def doc(toxic):
        w = [g.choice(WORDS[:150]) for _ in range(g.randint(20, 80))]
        if toxic:
            w[3], w[5] = g.choice(bad), g.choice(group)
        return " ".join(w)

    labels = [(i, int(g.random() < 0.3)) for i in range(1500)]
    rows = [(i, doc(y), "x") for i, y in labels] + [(5000, None, "x"), (5001, "", "x"), (None, "grubbing them", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    known = spark.createDataFrame([*labels, (0, None), (None, 1)], "doc_id long, toxic int")
    got = T.toxicity(df.drop("score"), known).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    truth = dict(labels)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 200 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    assert T.toxicity(df.drop("score").limit(0), known).count() == 0
    assert T.toxicity(df.drop("score"), known.limit(0)).filter("predicted = 1").count() == 0


def test_machine_learns_pairs():
    r = np.random.default_rng(1)
    rows, y = [], []
    for _ in range(3000):
        a, b = r.random(2) < 0.5
        rows.append(np.array([k for k, on in ((1, a), (2, b), (3, True)) if on]))
        y.append(float(a and b))
    m = T.fit(rows, np.array(y), bits=4)
    lin = [m.score(np.zeros(len(t), int), np.array(t), 1)[0] for t in ([1, 3], [2, 3], [1, 2, 3], [3])]
    assert lin[2] > 0.5 > max(lin[0], lin[1], lin[3])
    assert T.fit([], np.array([])).score(np.empty(0, int), np.empty(0, int), 1)[0] < 0.01


def test_each_level_of_reputation_flips_a_verdict(spark):
    g = random.Random(3)
    pages, bad = [], []

    def host(name, share, n=80):
        for _ in range(n):
            i = len(pages)
            pages.append((i, f"http://{name}/{i}"))
            if g.random() < 0.7:  # the others are held out
                bad.append((i, int(g.random() < share)))

    for k in range(6):
        for h in ("a", "b"):
            host(f"{h}.evil{k}.junk", 0.9)
            host(f"{h}.fine{k}.good", 0.02)
            host(f"{h}.shop{k}.co.uk", 0.02)
    for h in "abc":
        host(f"{h}.spam.good", 0.95)
        host(f"{h}.spam.co.uk", 0.95)
        host(f"{h}.mixed.good", 0.95 if h == "a" else 0.02)
    fresh = ["new.unseen.junk", "new.spam.good", "new.fine1.good", "new.shop1.co.uk", "new.spam.co.uk:80", "new.mixed.good", "1.2.3.4", "1.2.3.4:80"]
    pages += [(10_000 + i, f"http://{h}/") for i, h in enumerate(fresh)]
    df = spark.createDataFrame(pages, "page_id long, url string")
    outcomes = spark.createDataFrame(bad, "page_id long, bad int")
    verdict = {r["page_id"]: r["verdict"] for r in U.judge_urls(df, outcomes, rules=()).collect()}
    # suffix, domain, domain, ..., the domain under a suffix of two labels
    assert [verdict[10_000 + i] for i in range(5)] == ["block", "block", "allow", "allow", "block"]
    assert verdict[10_006] == verdict[10_007] == "allow"
    by_host = {}
    for i, u in pages:
        by_host.setdefault(u.split("/")[2], set()).add(verdict[i])
    assert by_host["a.mixed.good"] == {"block"} and by_host["b.mixed.good"] == by_host["c.mixed.good"] == {"allow"}
    # pages whose labels were held out
    known = {i for i, _ in bad}
    rest = [(u, verdict[i]) for i, u in pages[:-8] if i not in known]
    right = [(v == "block") == (".junk" in u or ".spam." in u or "a.mixed" in u) for u, v in rest]
    assert len(rest) > 500 and sum(right) / len(right) > 0.97
    # without a list of suffixes co.uk is one domain
    plain = {r["page_id"]: r["verdict"] for r in U.judge_urls(df, outcomes, rules=(), suffixes=()).collect()}
    assert plain[10_004] == "allow"
    # outcomes that say nothing about hosts block nothing
    noise = spark.createDataFrame([(i, int(g.random() < 0.25)) for i, _ in pages], "page_id long, bad int")
    assert U.judge_urls(df, noise, rules=()).filter("verdict = 'block'").count() <= 10


def kinds(spark, *texts):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id int, text string, found string, _t string")
    got = {r["doc_id"]: [(P.KINDS[s["kind"]].name, texts[r["doc_id"]][s["start"] : s["end"]], s["score"]) for s in r["found"]] for r in P.find_pii(df).collect()}
    return [got[i] for i in range(len(texts))]


def test_scores_and_added_kinds(spark):
    token = "ffc3105535f423f352535e4ac53b5fefe076ac6d"
    got = kinds(
        spark,
        f'they token = "{token}" of',
        f'commit {token} and "{token[:19]}"',
        f"the sha1 of the token {token}",
        "token = abcdefghijklmnopqrstuvwxyz",
        "pay to GB82 WEST 1234 5698 7654 32 AND more, DE89370400440532013000",
        "GB82 WEST 1234 5698 7654 33, GB82WEST123456987654, order GB82WEST12345698765432",
        "social security 123-45-6789, 123-45-6780, security 000-45-6789",
        "card 4111 1111 1111 1111 host 1.2.3.4, version 1.2.3.5",
    )
    assert got[0] == [("secret", token, 60)] and got[1] == got[2] == got[3] == []
    assert got[4] == [("iban", "GB82 WEST 1234 5698 7654 32", 60), ("iban", "DE89370400440532013000", 60)]
    assert got[5] == []  # a wrong check digit, too short, and words against it
    assert got[6] == [("ssn", "123-45-6789", 60)]
    assert got[7] == [("card", "4111 1111 1111 1111", 90), ("ip", "1.2.3.4", 90), ("ip", "1.2.3.5", 30)]


def test_many_matches_are_linear(spark):
    text = "1.2.3.4 a@b.cd, " * 50_000
    df = spark.createDataFrame([(None, text), (None, text), (1, "")], "doc_id long, text string")
    P.find_pii(df.limit(1)).collect()
    began = time.time()
    got = P.find_pii(df).collect()
    assert time.time() - began < 30
    many = [r["found"] for r in got if r["found"]]
    assert len(got) == 3 and len(many) == 2
    for f in many:
        assert len(f) == 100_000
        assert all(text[s["start"] : s["end"]] == ("a@b.cd", "1.2.3.4")[s["kind"]] for s in f[::997])


def test_machine_is_the_double_sum():
    r = np.random.default_rng(3)
    m = T.Machine(np.arange(12), 0.3, r.normal(size=12), r.normal(size=(12, 4)))
    rows = [np.array([0, 3, 7, 11]), np.array([5]), np.array([], int), np.arange(12)]
    term = np.concatenate(rows)
    row = np.repeat(np.arange(4), [len(x) for x in rows])
    for got, x in zip(m.raw(row, term, 4)[0], rows):
        want = 0.3 + m.weight[x].sum() + sum(m.latent[i] @ m.latent[j] for i in x for j in x if i < j)
        assert abs(got - want) < 1e-9


def test_machine_learns_what_only_pairs_tell(spark):
    """Toxic if exactly one of two words stands there: neither word alone says anything, and no additive score can tell."""
    g = random.Random(21)

    def doc(toxic):
        a = g.random() < 0.5
        b = a ^ bool(toxic)
        w = [g.choice(WORDS[:60]) for _ in range(25)] + ["zorble"] * a + ["quaxing"] * b
        g.shuffle(w)
        return " ".join(w)

    labels = [(i, int(g.random() < 0.4)) for i in range(3000)]
    df = spark.createDataFrame([(i, doc(y), "x", 7, "h") for i, y in labels], "doc_id long, text string, score string, predicted int, _score string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = T.toxicity(df, known)
    assert out.columns == ["doc_id", "text", "_score", "held_out", "score", "predicted"]
    truth = dict(labels)
    held = [r for r in out.collect() if r["held_out"]]
    assert len(held) > 400 and {r["_score"] for r in held} == {"h"}
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.9
