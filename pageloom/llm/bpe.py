"""Exact BPE by dynamic programming over prefixes.

For every prefix of a word there is one token that ends its encoding. It is found among the vocabulary's tokens that
are suffixes of the prefix: the one whose left neighbour, the last token of the shorter prefix, is compatible with it,
that is, for which merging would not have crossed the border between the two. Following the stored tokens back from the
end gives the ids that merging by rank gives, without merging.

The automaton that matches the suffixes is a trie of the vocabulary's tokens with suffix links (Aho and Corasick's), not
a suffix automaton of the vocabulary. Both find the same tokens at every prefix; the states of a suffix automaton that
are no beginning of a token cannot become one by reading on, so they are left out, and a third of the memory is enough.

A compatible pair is tested by undoing the merges of both tokens, the later one first: if at some stage the two pieces
that touch could have merged before the stage was reached, the pair would not have come about.

The distinct new words of some texts are encoded in step, position by position, as arrays; words of more than LONG bytes
one at a time by the same rule. The vocabulary is read from a tokenizers JSON file on every worker; its path is a
parameter. Words are kept in tables of bounded size.
"""

from __future__ import annotations

import hashlib
import json
import re
import string
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import held, small_batches

#: Words kept, and pieces of words kept.
KEEP_WORDS = 200_000
#: Bytes beyond which a word is encoded by itself, and the tested pairs that are kept for such words.
LONG, KEEP_PAIRS = 64, 100_000
#: Pieces encoded in step, and characters of texts whose words are taken together.
AT_ONCE, TOGETHER = 16_384, 1 << 19
_SPACES = r"\t-\r\x20\x85\xa0  -     　"
_ODD = re.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(n)
            n += 1
    return [out[b] for b in range(256)]


def _newer() -> str:
    """Ranges of letters and numbers that regex knows and unicodedata doesn't: too new for the tokenizers library."""
    known, points = regex.compile(r"[\p{L}\p{N}]"), []
    for block in range(0, 0x110000, 1 << 14):
        text = "".join(chr(c) for c in range(block, block + (1 << 14)) if not 0xD800 <= c < 0xE000)
        points += [ord(c) for c in known.findall(text) if unicodedata.category(c) == "Cn"]
    starts = [c for c, before in zip(points, [-2, *points], strict=False) if c != before + 1]
    ends = [c for c, after in zip(points, [*points[1:], -2], strict=True) if c != after - 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True))


class _Hash:
    """A fixed table of numbers by numbers from 0, looked up for many keys at once."""

    def __init__(self, known: dict[int, int]):
        bits = max(4, (2 * len(known)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        keys = np.fromiter(known.keys(), np.int64, len(known))
        values = np.fromiter(known.values(), np.int32, len(known))
        at = self._first(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]  # of several for one place the last stays
            own = self.keys[at] == keys
            self.values[at[own]] = values[own]
            keys, values, at = keys[~own], values[~own], (at[~own] + 1) & self.mask

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        at = self._first(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        rest = np.flatnonzero((found != keys) & (found >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & self.mask
            found = self.keys[at[rest]]
            hit = found == keys[rest]
            out[rest[hit]] = self.values[at[rest[hit]]]
            rest = rest[~hit & (found >= 0)]
        return out


class BPE:
    """Words (as bytes) to token ids, many words in step."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        letters = byte_letters()
        base = [vocab[x] for x in letters] + [vocab[x + suffix] for x in letters]
        made: dict[int, tuple[int, int, int]] = {}  # rank and parts of tokens made by a merge
        pairs: dict[int, int] = {}
        for i, (a, b) in enumerate(merges):
            made.setdefault(vocab[a + b], (i, vocab[a], vocab[b]))
            pairs.setdefault(vocab[a] << 32 | vocab[b], i)
        size = max(vocab.values()) + 1
        self.rank, self.left, self.right = (np.full(size, -1, np.int32) for _ in range(3))
        for t, (i, a, b) in made.items():
            self.rank[t], self.left[t], self.right[t] = i, a, b
        self.pairs = _Hash(pairs)
        self._automaton(base, made)

    def _automaton(self, base: list[int], made: dict[int, tuple[int, int, int]]) -> None:
        """Trie of all tokens; per state its suffix link, its token and the nearest state by links that has one."""
        symbol = {t: c for c, t in enumerate(base)}
        spelled: dict[int, tuple[int, ...]] = {t: (c,) for t, c in symbol.items()}
        to: dict[int, int] = {}
        token, depth, parent, by = [-1], [0], [0], [0]
        for t in [*symbol, *made]:  # a token's parts come before it
            if t not in spelled:
                spelled[t] = spelled[made[t][1]] + spelled[made[t][2]]
            s = 0
            for c in spelled[t]:
                nxt = to.get(s << 9 | c)
                if nxt is None:
                    nxt = to[s << 9 | c] = len(token)
                    token.append(-1)
                    depth.append(depth[s] + 1)
                    parent.append(s)
                    by.append(c)
                s = nxt
            token[s] = t
        link, nearest = [0] * len(token), [0] * len(token)
        for s in sorted(range(1, len(token)), key=depth.__getitem__):
            p, c = parent[s], by[s]
            if p:
                f = link[p]
                while f and f << 9 | c not in to:
                    f = link[f]
                link[s] = to.get(f << 9 | c, 0)
            nearest[s] = s if token[s] >= 0 else nearest[link[s]]
        self.to = _Hash(to)
        self.token, self.depth, self.link, self.nearest = (np.array(x, np.int32) for x in (token, depth, link, nearest))

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each b can follow its a in an encoding.

        after_a, after_b: ranks of the merges that hid the pieces. At one rank merges go from left to right, so the
        border's comes before one on its right and after one on its left, and the right one is undone first.
        """
        key, where = np.unique(a.astype(np.int64) << 32 | b, return_inverse=True)
        out = np.ones(len(key), bool)
        live, a, b = np.arange(len(key)), (key >> 32).astype(np.int32), (key & 0xFFFFFFFF).astype(np.int32)
        after_a = after_b = np.full(len(key), np.iinfo(np.int32).max, np.int32)
        while len(live):
            crossing = self.pairs.get(a.astype(np.int64) << 32 | b)
            bad = (crossing >= 0) & (crossing < after_a) & (crossing <= after_b)
            out[live[bad]] = False
            rank_a, rank_b = self.rank[a], self.rank[b]
            on = ~bad & ((rank_a >= 0) | (rank_b >= 0))
            live, a, b, rank_a, rank_b, after_a, after_b = (x[on] for x in (live, a, b, rank_a, rank_b, after_a, after_b))
            of_a = rank_a > rank_b
            a, after_a = np.where(of_a, self.right[a], a), np.where(of_a, rank_a, after_a)
            b, after_b = np.where(of_a, b, self.left[b]), np.where(of_a, after_b, rank_b)
        return out[where]

    def _step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The automaton's states after one more symbol each."""
        out = np.zeros(len(state), np.int32)
        rest = np.arange(len(state))
        while len(rest):
            found = self.to.get(state[rest].astype(np.int64) << 9 | c[rest])
            hit = found >= 0
            out[rest[hit]] = found[hit]
            rest = rest[~hit & (state[rest] > 0)]
            state[rest] = self.link[state[rest]]
        return out

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, little-endian unsigned 32-bit."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-sizes, kind="stable").tolist()
        size = sizes[order]
        flat = np.frombuffer(b"".join(words[i] for i in order), np.uint8)
        start = np.cumsum(size) - size
        longest = int(size[0]) if len(size) else 0
        last, back = np.zeros((longest, len(words)), np.int32), np.zeros((longest, len(words)), np.int32)
        state = np.zeros(len(words), np.int32)
        for i in range(longest):
            n = int(np.searchsorted(-size, -i, side="left"))  # words that are longer than i
            state = self._step(state[:n], flat[start[:n] + i].astype(np.int64) + 256 * (size[:n] == i + 1))
            m, rest = self.nearest[state], np.arange(n)
            while len(rest):
                depth, token = self.depth[m[rest]], self.token[m[rest]]
                last[i, rest], back[i, rest] = token, depth
                inner = np.flatnonzero(depth <= i)
                fits = self.compatible(last[i - depth[inner], rest[inner]], token[inner])
                rest = rest[inner[~fits]]
                m[rest] = self.nearest[self.link[m[rest]]]
        return self._followed(order, size, last, back)

    @staticmethod
    def _followed(order, size, last, back) -> list[bytes]:
        """The stored tokens from the end of each word back to its start, in order."""
        at, ids, live = size - 1, [], np.flatnonzero(size)
        count = np.zeros(len(size), np.int64)
        while len(live):
            ids.append((live, last[at[live], live]))
            count[live] += 1
            at[live] -= back[at[live], live]
            live = live[at[live] >= 0]
        end = np.cumsum(count)
        flat = np.empty(int(end[-1]) if len(end) else 0, "<u4")
        for k, (lanes, tokens) in enumerate(ids):
            flat[end[lanes] - 1 - k] = tokens
        raw, cut = flat.tobytes(), (4 * end).tolist()
        out = [b""] * len(order)
        for i, a, b in zip(order, [0, *cut], cut, strict=False):
            out[i] = raw[a:b]
        return out


class _LongWords:
    """The same rule for one word at a time, for words of more than LONG bytes; made when one comes and then dropped."""

    def __init__(self, bpe: BPE):
        used = bpe.to.keys >= 0
        self.to = dict(zip(bpe.to.keys[used].tolist(), bpe.to.values[used].tolist(), strict=True))
        self.token, self.depth, self.link, self.nearest = (x.tolist() for x in (bpe.token, bpe.depth, bpe.link, bpe.nearest))
        self.fits: dict[tuple[int, int], bool] = {}
        self.bpe = bpe

    def _fit(self, a: int, b: int) -> bool:
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) >= KEEP_PAIRS:
                self.fits.clear()
            known = self.fits[a, b] = bool(self.bpe.compatible(np.array([a], np.int32), np.array([b], np.int32))[0])
        return known

    def encode(self, word: bytes) -> bytes:
        to, link, ends, sizes = self.to, self.link, array("i"), array("i")
        s, final = 0, len(word) - 1
        for i, c in enumerate(word):
            c += 256 * (i == final)
            while s and s << 9 | c not in to:
                s = link[s]
            s = to.get(s << 9 | c, 0)
            m = self.nearest[s]
            while self.depth[m] <= i and not self._fit(ends[i - self.depth[m]], self.token[m]):
                m = self.nearest[link[m]]
            ends.append(self.token[m])
            sizes.append(self.depth[m])
        out, at = array("I"), final
        while at >= 0:
            out.append(ends[at])
            at -= sizes[at]
        out.reverse()
        return out.tobytes()


class Tokenizer:
    """The pipeline of a word-level BPE file: special tokens, NFC, white space, lower case, split, bytes, BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        splits = spec["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in splits] != ["Split", "ByteLevel"] or spec["decoder"] is not None:
            raise ValueError(f"{path} is a tokenizer of another kind")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.bpe = BPE(model["vocab"], merges, model["end_of_word_suffix"])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        every = {i: s for s, i in [*model["vocab"].items(), *self.added.items()]}
        self.names: list[str | None] = [every.get(i) for i in range(max(every) + 1)]
        self.special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")")
        self.mark = min(self.added, key=len)[:2] if self.added else ""
        pattern = splits[0]["pattern"]["Regex"].replace(r"[^\s", f"[^{_SPACES}")
        self.piece = regex.compile(pattern)
        new = _newer()
        self.newer = regex.compile(f"[{new}]" if new else "(?!)")
        careful = pattern.replace(r"[\p{L}]", rf"[\p{{L}}--[{new}]]").replace(r"[\p{N}]", rf"[\p{{N}}--[{new}]]")
        careful = careful.replace(rf"[^{_SPACES}\p{{L}}\p{{N}}]", rf"[[^{_SPACES}\p{{L}}\p{{N}}]||[{new}]]")
        self.careful = regex.compile("(?V1)" + careful) if new else self.piece
        self.words: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    def _pieces(self, word: str) -> list[str]:
        """What a stretch without white space is cut into: normalised, lower case."""
        low = word.lower() if word.isascii() else unicodedata.normalize("NFC", word).replace("Σ", "σ").lower()  # letter by letter: no final form of sigma
        letters = low.rstrip(string.punctuation)
        if letters.isalpha():  # letters of that kind are never newer ones
            return [low] if len(letters) == len(low) else [letters, low[len(letters) :]]
        return (self.piece if low.isascii() or not self.newer.search(low) else self.careful).findall(low)

    def learn(self, stretches: list[str]) -> None:
        """Takes the words of a text, or of several, into the table: all of them are in it afterwards."""
        new = set(stretches).difference(self.words)
        if len(self.words) + len(new) > KEEP_WORDS:
            self.words, new = {}, set(stretches)
        cut = [(w, self._pieces(w)) for w in new]
        if len(self.known) > KEEP_WORDS:
            self.known = {}
        fresh = list(set(chain.from_iterable([ps for _, ps in cut])).difference(self.known))
        for at in range(0, len(fresh), AT_ONCE):
            self._encode(fresh[at : at + AT_ONCE])
        known = self.known
        for w, ps in cut:
            self.words[w] = known[ps[0]] if len(ps) == 1 else b"".join([known[p] for p in ps])

    def _encode(self, pieces: list[str]) -> None:
        raw = [p.encode("utf-8") for p in pieces]
        short = [i for i, r in enumerate(raw) if len(r) <= LONG]
        self.known.update(zip([pieces[i] for i in short], self.bpe.encode([raw[i] for i in short]), strict=True))
        if len(short) < len(raw):
            one = _LongWords(self.bpe)
            self.known.update((p, one.encode(r)) for p, r in zip(pieces, raw, strict=True) if len(r) > LONG)

    def parts(self, text: str) -> tuple[list[int], list[list[str]]]:
        """The special tokens of a text, and the stretches without white space before, between and behind them."""
        cut = self.special.split(text) if self.mark and self.mark in text else [text]
        words = [re.split(f"[{_SPACES}]+", own) if _ODD.search(own) else own.split() for own in cut[::2]]
        return [self.added[s] for s in cut[1::2]], words

    def ids(self, parts: tuple[list[int], list[list[str]]]) -> array:
        """The ids of a text, given by its parts, all of whose words have been learned."""
        marks, words = parts
        out = b"".join(map(self.words.__getitem__, words[0]))
        for mark, after in zip(marks, words[1:], strict=True):
            out += array("I", [mark]).tobytes() + b"".join(map(self.words.__getitem__, after))
        return array("I", out)

    def encode(self, text: str) -> list[int]:
        parts = self.parts(text)
        self.learn([w for ws in parts[1] for w in ws])
        return self.ids(parts).tolist()

    def decode(self, ids) -> str:
        return " ".join([x for x in map(self.names.__getitem__, ids) if x is not None])

    def encode_all(self, texts: Iterator[str]) -> Iterator[array]:
        """The ids of each text; texts are taken together until they have TOGETHER characters."""
        held, size = [], 0

        def flush():
            cut = [self.parts(t) for t in held]
            self.learn([w for _, words in cut for ws in words for w in ws])
            yield from map(self.ids, cut)
            held.clear()

        for text in texts:
            held.append(text)
            size += len(text)
            if size >= TOGETHER:
                yield from flush()
                size = 0
        yield from flush()


def _tokenizer(path: str) -> Tokenizer:
    return held(("bpe", path), lambda: Tokenizer(path))


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of each row; null texts count as empty."""

    def run(batches):
        tok = _tokenizer(path)
        for batch in batches:
            n, a, b = [], [], []
            for ids in tok.encode_all(text.as_py() or "" for text in batch.column(1)):
                n.append(len(ids))
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(tok.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids of each row; null texts count as empty."""

    def run(batches):
        tok = _tokenizer(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [x.tolist() for x in tok.encode_all(t.as_py() or "" for t in part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def count_tokens(docs: DataFrame, path: str, count: str = "n_tokens") -> DataFrame:
    """docs with count, the number of ids of each row's text; null texts have none."""
    rows = docs.select(*[c for c in docs.columns if c != count])
    at, names = rows.columns.index("text"), rows.columns

    def run(batches):
        tok = _tokenizer(path)
        for batch in batches:
            n = [len(ids) for ids in tok.encode_all(t.as_py() or "" for t in batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=[*names, count])

    return small_batches(rows).mapInArrow(run, StructType(list(rows.schema.fields)).add(count, "long"))
