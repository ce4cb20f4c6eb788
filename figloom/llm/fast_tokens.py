"""Encoding of whole batches with a ``tokenizers`` file, each distinct word once.

The two public BPE files used here split a text into words and merge inside
words only.  So a batch is cut in words by array operations on code points, equal
words are found by 64-bit hashes, and the library encodes just the words not
seen before (joined by a separator, which it splits off again).  The result
equals ``encode_batch``; files of another structure go through ``encode_batch``.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
from xxhash import xxh64_intdigest

#: A chunk is so many code points, or one text.
CHUNK = 1_000_000
#: The cache starts anew beyond so many words (about 60 bytes each).
MAX_WORDS = 800_000
#: Code points of Unicode's White_Space, as the files' patterns use it.
SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")
SPACE, LETTER, NUMBER, OTHER = range(4)
#: Words of more code points are told apart by XXH64.
LONG_WORD = 100

_tables: dict = {}


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Per code point its class and a 64-bit mixed value."""
    if not _tables:
        cls = np.full(0x110000, OTHER, np.uint8)
        cats = {"L": LETTER, "N": NUMBER}
        for c in range(0x110000):
            k = cats.get(unicodedata.category(chr(c))[0])
            if k:
                cls[c] = k
        cls[SPACES] = SPACE
        x = np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        _tables["cls"], _tables["mix"] = cls, x ^ (x >> np.uint64(31))
    return _tables["cls"], _tables["mix"]


P = 0x9E3779B97F4A7C15
P_INV = pow(P, -1, 2**64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^0..P^(n-1) and the inverses' powers, modulo 2^64."""
    if len(_tables.get("p", ())) < n:
        m = 1 << max(20, (n - 1).bit_length())
        for key, base in (("p", P), ("q", P_INV)):
            a = np.full(m, base, np.uint64)
            a[0] = 1
            _tables[key] = np.multiply.accumulate(a)
    return _tables["p"][:n], _tables["q"][:n]


def spans_hash(code: np.ndarray, mix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of code points."""
    p, q = _powers(len(code) + 1)
    sums = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(mix[code] * p[:-1], out=sums[1:])
    h = (sums[end] - sums[start]) * q[start] + (end - start).astype(np.uint64)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class FastEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        kinds = [x.get("type") for x in pre.get("pretokenizers", [])]
        self.mode = "plain"
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not norm and not pre.get("add_prefix_space"):
            self.mode = "byte"
        elif kinds == ["Split", "ByteLevel"] and [x.get("type") for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            self.mode = "word"
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        vocab = spec["model"]["vocab"]
        self.newline = vocab.get("Ċ")
        self.is_end = np.zeros(max(vocab.values()) + 1, bool)
        self.is_end[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self._reset()

    def _reset(self) -> None:
        self.hashes = np.empty(0, np.uint64)
        self.off = np.empty(0, np.int64)
        self.len = np.empty(0, np.int64)
        self.pool = np.empty(1 << 16, np.uint32)
        self.used = 0

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has."""
        if self.mode == "plain":
            got = [e.ids for e in self.tok.encode_batch(texts, add_special_tokens=False)]
            return np.array([i for g in got for i in g], np.uint32), np.array([len(g) for g in got], np.int64)
        flats, counts, chunk, size = [], [], [], 0

        def flush() -> None:
            nonlocal chunk, size
            if chunk:
                a, b = self._chunk(chunk)
                flats.append(a)
                counts.append(b)
            chunk, size = [], 0

        for t in texts:
            if any(x in t for x in self.added):  # the library cuts such a text at its added tokens
                flush()
                ids = np.array(self.tok.encode(t, add_special_tokens=False).ids, np.uint32)
                flats.append(ids)
                counts.append(np.array([len(ids)], np.int64))
                continue
            if size + len(t) > CHUNK:
                flush()
            chunk.append(t)
            size += len(t)
        flush()
        return (np.concatenate(flats), np.concatenate(counts)) if flats else (np.empty(0, np.uint32), np.empty(0, np.int64))

    def _chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.mode == "word":
            # the library lowers letter by letter, without the rule for a final sigma
            texts = [unicodedata.normalize("NFC", t).replace("Σ", "σ").lower() for t in texts]
        cls_of, mix = _classes()
        joined = "".join(texts)
        n = len(joined)
        ends = np.cumsum([len(t) for t in texts])
        if not n:
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        cls = cls_of[code]
        run = np.empty(n + 1, bool)  # a run of one class starts here
        run[0] = run[n] = True
        np.not_equal(cls[1:], cls[:-1], out=run[1:n])
        edge = np.zeros(n + 1, bool)  # a text starts here
        edge[0] = edge[n] = True
        edge[ends] = True
        run |= edge
        start = run.copy()
        if self.mode == "byte":
            at = np.flatnonzero(run)
            s, e = at[:-1], at[1:]
            blank = (cls[s] == SPACE) & ~edge[e]
            start[e[blank & (e - s > 1)] - 1] = True  # a long run of white space leaves its last to what follows
            joins = e[blank]
            start[joins[code[joins - 1] == 32]] = False  # a space leads the word
        else:
            start[:n] |= cls == NUMBER
        quote = np.flatnonzero((code == 39) & start[:n])
        for p in quote.tolist():
            stop = int(ends[np.searchsorted(ends, p, side="right")])
            for c in CONTRACTIONS:
                q = p + 1 + len(c)
                if q <= stop and joined.startswith(c, p + 1):
                    start[p + 1 : q] = False
                    start[q] = True
                    break
        at = np.flatnonzero(start)
        s, e = at[:-1], at[1:]
        if self.mode == "word":
            solid = cls[s] != SPACE
            s, e = s[solid], e[solid]
        h = spans_hash(code, mix, s, e)
        for i in np.flatnonzero(e - s > LONG_WORD).tolist():  # the sums' modulus has known collisions of long words
            h[i] = xxh64_intdigest(joined[s[i] : e[i]].encode("utf-8", "surrogatepass"), 42)
        uniq, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        slot = self._slots(uniq, first, joined, s, e)[inverse]
        length = self.len[slot]
        where = np.zeros(len(slot) + 1, np.int64)
        np.cumsum(length, out=where[1:])
        flat = self.pool[np.repeat(self.off[slot] - where[:-1], length) + np.arange(where[-1])]
        bounds = where[np.searchsorted(s, ends)]
        return flat, np.diff(bounds, prepend=0)

    def _slots(self, uniq: np.ndarray, first: np.ndarray, joined: str, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        if len(self.hashes) > MAX_WORDS:
            self._reset()
        if len(self.hashes):
            at = np.searchsorted(self.hashes, uniq)
            known = self.hashes[np.minimum(at, len(self.hashes) - 1)] == uniq
        else:
            at, known = np.zeros(len(uniq), np.int64), np.zeros(len(uniq), bool)
        new = np.flatnonzero(~known)
        if len(new):
            f = first[new]
            words = [joined[a:b] for a, b in zip(s[f].tolist(), e[f].tolist(), strict=True)]
            ids, counts = self._encode_words(words)
            if self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool[: self.used], np.empty(self.used + 2 * len(ids), np.uint32)])
            self.pool[self.used : self.used + len(ids)] = ids
            offs = self.used + np.cumsum(counts) - counts
            self.used += len(ids)
            self.hashes = np.insert(self.hashes, at[new], uniq[new])
            self.off = np.insert(self.off, at[new], offs)
            self.len = np.insert(self.len, at[new], counts)
            at = np.searchsorted(self.hashes, uniq)
        return at

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out: list = [None] * len(words)
        plain = [i for i, w in enumerate(words) if not w[-1].isspace() and len(w) < 200 and not re.search(r"\s", w[1:])]
        for k in range(0, len(plain), 20_000):
            part = plain[k : k + 20_000]
            if self.mode == "byte":
                ids = np.array(self.tok.encode("\n".join([words[i] for i in part]), add_special_tokens=False).ids, np.uint32)
                cut = np.flatnonzero(ids == self.newline)
                pieces = np.split(ids, cut)
                pieces = [pieces[0], *[x[1:] for x in pieces[1:]]]
            else:
                ids = np.array(self.tok.encode(" ".join([words[i] for i in part]), add_special_tokens=False).ids, np.uint32)
                pieces = np.split(ids, np.flatnonzero(self.is_end[ids])[:-1] + 1)
            if len(pieces) == len(part):
                for i, x in zip(part, pieces, strict=True):
                    out[i] = x
        rest = [i for i, x in enumerate(out) if x is None]
        for i, g in zip(rest, self.tok.encode_batch([words[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(g.ids, np.uint32)
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)


_encoders: dict[str, FastEncoder] = {}


def encoder(path: str) -> FastEncoder:
    """The process's encoder of a file."""
    if path not in _encoders:
        _encoders[path] = FastEncoder(path)
    return _encoders[path]
