"""Language identification by cross-parsing entropy.

For every language a suffix automaton is built over a sample of labelled text. A text is parsed against it into
phrases, each the longest match with any part of the sample from where the last one ended; a character that the sample
lacks is a phrase of its own. Phrases times log2(sample length), over the characters, estimate the cross entropy in
bits a character; the language with the least wins, the first in order of names on a tie.

Texts are lower-cased, and whatever is not a letter becomes one blank. They are parsed in blocks of BLOCK characters
from their start, each anew, so that a long text is parsed like many short ones. The automata are used as dense
transition tables with the phrase ends marked, over all blocks in step.

A phrase costs the same however short it is, and the edges of a text cut its first and last phrase short; few characters
thus cost many bits each even if they match. lang_sure leaves EDGES phrases out, and is what a text can be rejected by.
Characters that the sample lacks are no matches and are never left out.

The sample has up to BUCKETS documents a language, the one of least hash in each bucket of hashes, and SAMPLE characters
in all, for MAX_LANGS languages at most: bounds of the labelled text that do not grow with the corpus. Texts that are
null or without letters are `und`; a corpus without labelled text gives `und` throughout. doc_id may be of any type.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, held, small_batches

BUCKETS, PER_DOC, SAMPLE, BLOCK = 64, 4_000, 30_000, 512
MAX_LANGS = 200
#: Matched phrases that the edges of a text may have cut short.
EDGES = 2
UND = "und"
_BATCH_CHARS = 1 << 20
_BREAK = np.int32(1 << 29)  # one phrase; the state is below it
_LETTER = np.zeros(0x110000, bool)
_LETTER[[i for i in range(0x110000) if unicodedata.category(chr(i))[0] == "L"]] = True


def _points(text: str) -> np.ndarray:
    """Code points of the normalised text."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(_LETTER[c], c, np.uint32(32))
    return c[(c != 32) | np.concatenate([[True], c[:-1] != 32])] if len(c) else c


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that reads every part of symbols; state 0 is the start."""
    to: list[dict[int, int]] = [{}]
    length, link, last = [0], [-1], 0
    for c in symbols:
        new = len(to)
        to.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = new
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(to)
                to.append(dict(to[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return to


@dataclass
class CrossParser:
    """Tables of all languages; made on each worker from the samples, which are small."""

    langs: list[str]
    symbol: np.ndarray
    tables: list[np.ndarray]
    weights: list[float]
    width: int

    @classmethod
    def of(cls, samples: dict[str, str]) -> CrossParser:
        langs = sorted(samples)
        points = {x: _points(samples[x]) for x in langs}
        letters = sorted(set(np.concatenate([*points.values(), np.array([32], np.uint32)]).tolist()))
        symbol = np.ones(0x110000, np.int32)  # 0 pads, 1 is a letter of no sample
        for i, c in enumerate(letters):
            symbol[c] = i + 2
        width = len(letters) + 2
        tables = []
        for x in langs:
            to = suffix_automaton((symbol[points[x]]).tolist())
            start = np.zeros(width, np.int32)
            for c, s in to[0].items():
                start[c] = s * width
            # no match: a phrase ends, and the next begins here or, if the sample lacks the character, is that one
            table = np.repeat((start + np.where(start == 0, 2 * _BREAK, _BREAK))[None], len(to), axis=0)
            table[0] = _BREAK
            for s, edges in enumerate(to):
                if edges:
                    table[s, list(edges)] = np.array(list(edges.values()), np.int32) * width
            table[:, 0] = np.arange(len(to), dtype=np.int32) * width
            tables.append(table.reshape(-1))
        return cls(langs, symbol, tables, [max(1.0, np.log2(max(2, len(points[x])))) for x in langs], width)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text against each language."""
        cuts = [range(0, len(x), BLOCK) for x in texts]
        owner = np.repeat(np.arange(len(texts)), [len(c) for c in cuts])
        out = np.zeros((len(self.langs), len(texts)), np.int64)
        if not len(owner):
            return out.T
        lanes = np.zeros((len(owner), BLOCK), np.int32)
        i = 0
        for x, c in zip(texts, cuts, strict=True):
            sym = self.symbol[x]
            n = len(c)
            flat = np.zeros(n * BLOCK, np.int32)
            flat[: len(sym)] = sym
            lanes[i : i + n] = flat.reshape(n, BLOCK)
            i += n
        longest = (lanes != 0).sum(axis=1)
        order = np.argsort(-longest, kind="stable")
        steps = np.ascontiguousarray(lanes[order].T)
        live = np.searchsorted(-longest[order], -np.arange(BLOCK), side="left")
        for k, table in enumerate(self.tables):
            state = np.zeros(len(owner), np.int32)
            count = np.zeros(len(owner), np.int32)
            for t in range(int(longest.max())):
                n = live[t]
                now = table[state[:n] + steps[t, :n]]
                count[:n] += now >> 29
                state[:n] = now & (_BREAK - 1)
            count += state != 0
            np.add.at(out[k], owner[order], count)
        return out.T

    def lacking(self, k: int, text: np.ndarray) -> int:
        """Characters of text that the sample of the k-th language lacks; each is a phrase of its own."""
        return int((self.tables[k][: self.width][self.symbol[text]] >= _BREAK).sum())

    def classify(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float], list[float]]:
        """Language, score (how far the runner-up is behind, 0 to 1), bits a character of each text, and those bits
        without the phrases at its edges."""
        lang, score, bits, sure = [UND] * len(texts), [0.0] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        points, rows, size = [], [], 0

        def flush():
            found = self.phrases(points)
            for i, n, x in zip(rows, found, points, strict=True):
                cost = n * np.array(self.weights)
                best = int(np.argmin(cost))
                rest = np.delete(cost, best).min() if len(cost) > 1 else np.inf
                lang[i], score[i], bits[i] = self.langs[best], float(1 - cost[best] / rest) if rest else 0.0, float(cost[best] / len(x))
                edges = min(EDGES, int(n[best]) - self.lacking(best, x))
                sure[i] = float((n[best] - edges) * self.weights[best] / len(x))

        for i, text in enumerate(texts):
            x = _points(text) if text and self.langs else np.empty(0, np.uint32)
            if (x != 32).any():
                points.append(x)
                rows.append(i)
                size += len(x)
            if points and (size > _BATCH_CHARS or i == len(texts) - 1):
                flush()
                points, rows, size = [], [], 0
        if points:
            flush()
        return lang, score, bits, sure


def held_out(doc_id):
    """Whether crc32 of the id's decimal text is a multiple of 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def samples(docs: DataFrame, exclude=None) -> dict[str, str]:
    """Bounded training text by language; exclude is a condition on rows that may not be learned from.

    The MAX_LANGS languages of most documents are learned. Of each, every chosen document gives as many characters as
    SAMPLE allows if all give equally many, those that have fewer giving all of theirs.
    """
    rows = docs.where("lang is not null and text is not null and doc_id is not null").where(F.col("text").rlike("\\p{L}"))
    if exclude is not None:
        rows = rows.where(~exclude)
    rows = rows.select(F.col("lang").cast("string").alias("lang"), "doc_id", "text")
    h = F.xxhash64("doc_id")
    firsts = rows.groupBy("lang", F.pmod(h, F.lit(BUCKETS)).alias("bucket")).agg(F.min(F.struct(h.alias("h"), "doc_id")).alias("x"), F.count("*").alias("n"))
    firsts = cut(firsts.select("lang", "x.doc_id", "n"))
    names = [r[0] for r in firsts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()]
    ids = firsts.where(F.col("lang").isin(names)).select("lang", "doc_id").distinct()  # at most BUCKETS x MAX_LANGS
    chosen = rows.join(F.broadcast(ids), ["lang", "doc_id"]).select("lang", h.alias("h"), F.substring("text", 1, PER_DOC).alias("text")).distinct()
    found: dict[str, list[str]] = {}
    for r in sorted(chosen.collect(), key=lambda r: (r["lang"], r["h"], r["text"])):
        found.setdefault(r["lang"], []).append(r["text"])
    return {k: _evenly(v) for k, v in found.items()}


def _evenly(texts: list[str]) -> str:
    """Beginnings of all texts, SAMPLE characters in all at most."""
    left, share = SAMPLE, 0
    for i, n in enumerate(sorted(map(len, texts))):
        share = max(share, min(n, left // (len(texts) - i)))
        left -= min(n, left // (len(texts) - i))
    return " ".join(t[:share] for t in texts)[:SAMPLE]


def identify(docs: DataFrame, learned: dict[str, str], prefix: str = "lang_") -> DataFrame:
    """docs with lang_pred, lang_score (0 to 1), lang_bits (cross entropy in bits a character) and lang_sure (the same
    without the phrases at the edges) added, under another prefix if one is given. Columns of docs with these names are
    replaced; text is read as a string whatever its type."""
    sent = docs.sparkSession.sparkContext.broadcast(learned)
    added = [prefix + x for x in ("pred", "score", "bits", "sure")]
    docs = docs.select(*[c for c in docs.columns if c.lower() not in map(str.lower, added)])
    names = docs.columns
    at = names.index("text")

    def run(batches):
        texts = sent.value
        parser = held(("languages", tuple(sorted(texts.items()))), lambda: CrossParser.of(texts))
        for batch in batches:
            found = parser.classify(batch.column(at).to_pylist())
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(found, kinds, strict=True))], names=[*names, *added])

    schema = StructType(list(docs.schema.fields))
    for c, kind in zip(added, ("string", "double", "double", "double"), strict=True):
        schema = schema.add(c, kind)
    return small_batches(docs).mapInArrow(run, schema)
