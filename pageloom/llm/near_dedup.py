"""Chosen-path set similarity join over word shingles, and the groups of near-duplicates that it links.

Each document is its set of distinct k-word shingles (lower-cased A-Z, words between white space); fewer words give one
shingle of all of them. Sets are embedded as T minwise tokens. Each of TREES independent trees sends every set to the
node of one of its tokens; a node of at most LEAF sets is compared exhaustively, and a larger one branches by BRANCH
more tokens, level by level, until its parts are small. Documents that share frequent passages only are parted that
way. Sets that share nearly everything never part, so nodes of more than STAR first link their sets to their smallest
one, and twice each set is then linked to its likeliest partner; nodes whose sets are all linked already are closed. What is still large after LEVELS levels is compared in blocks.

A pair of similarity 0.75 misses all 8 roots with probability 0.25^8 = 1.5e-5. Candidates must agree in as many of the T
tokens as SLACK standard deviations below the threshold and have sizes in the ratio of the threshold; each is then confirmed on
both full sets. Equal sets are one class throughout and are never paired.

Null or blank texts have no shingles and are linked with nothing. Rows without doc_id are returned with a null
component and kept. Rows that repeat a doc_id share its fate; their texts are linked each on its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut, drop_held, matching, release, small_batches
from .shingles import shingles_of, words_of

T, TREES, BRANCH, LEVELS, LEAF, STAR = 256, 8, 2, 6, 2048, 8
SLACK = 3.5
ROUNDS = 2
#: Shingles that a task holds at a time when links are confirmed.
HELD = 1 << 22
_STEPS = np.random.default_rng(20240229).integers(1, 1 << 63, size=T, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ORDER = [list(np.random.default_rng(900 + t).permutation([c for c in range(T) if c != t])) for t in range(TREES)]


def _minwise(s: np.ndarray) -> np.ndarray:
    """The least value of each of T hashes: their upper halves are root tokens, 8 bits below those are compared."""
    low = np.full(T, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 1024):
        part = s[None, at : at + 1024]
        for p in range(0, T, 64):
            np.minimum(low[p : p + 64], (part * _STEPS[p : p + 64, None]).min(axis=1), out=low[p : p + 64])
    return low


def _sets(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[np.ndarray], list[bytes]]]:
    drop_held()
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            texts = (x.as_buffer().to_pybytes() if x.is_valid else b"" for x in part.column(1).cast(pa.large_string()))
            sets = [shingles_of(w, k) for w in words_of(texts)]
            yield part.column(0), sets, [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]


def signatures(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, cid (the set's 128-bit hash), n (its size), first (root tokens of the trees), sig (T tokens of 8 bits)."""

    def run(batches):
        for ids, sets, cids in _sets(k, batches):
            low = np.stack([_minwise(s) for s in sets])
            first = (low[:, :TREES] >> np.uint64(32)).astype(np.uint32).view(np.int32).reshape(-1)
            sig = (low >> np.uint64(16)).astype(np.uint8).view(np.int8).reshape(-1)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * k, pa.int32()), pa.array(v)) for k, v in ((TREES, first), (T, sig))]
            yield pa.RecordBatch.from_arrays([ids, pa.array(cids, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), *lists], names=["doc_id", "cid", "n", "first", "sig"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, cid binary, n long, first array<int>, sig array<byte>")


def full_sets(docs: DataFrame, k: int = 5) -> DataFrame:
    """cid and items, the sorted shingle hashes."""

    def run(batches):
        for _, sets, cids in _sets(k, batches):
            for at in range(0, len(sets), 64):
                own = sets[at : at + 64]
                ends = np.cumsum([0, *map(len, own)])
                items = pa.array(np.concatenate(own).view(np.int64), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(cids[at : at + 64], pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)], names=["cid", "items"])

    return small_batches(docs).select("doc_id", F.col("text").cast("string")).mapInArrow(run, "cid binary, items array<long>")


def agreement(threshold: float) -> int:
    """Tokens of T in which a pair at the threshold agrees but for SLACK standard deviations."""
    return math.ceil(T * threshold - SLACK * math.sqrt(T * threshold * (1 - threshold)))


def _similar(threshold: float):
    """Whether two rows (n, sig) can reach the threshold: sizes in ratio, and tokens that agree."""
    agree = F.size(F.filter(F.zip_with("sig", "sig_b", lambda x, y: x == y), lambda x: x))
    return (F.least("n", "n_b") >= threshold * F.greatest("n", "n_b")) & (agree >= agreement(threshold)), agree


def _pairs_of(rows: pa.Table, threshold: float, best: bool) -> tuple[list[bytes], list[bytes]]:
    """The pairs of a node that may be similar and have different labels. best: for each set only the likeliest."""
    if rows.num_rows < 2:
        return [], []
    cid = rows["cid"].to_pylist()
    order = sorted(range(len(cid)), key=cid.__getitem__)
    cid = [cid[i] for i in order]
    sig = rows["sig"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, T)[order]
    n = rows["n"].to_numpy()[order]
    label = rows["label"].to_numpy()[order]
    side = rows["side"].to_numpy()[order]
    tree = int(rows["tree"][0].as_py())
    first = rows["first"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, TREES)[order][:, :tree]
    whole = (rows["big"].to_numpy()[order][:, None] >> np.arange(tree)) & 1 == 0
    least = agreement(threshold)
    out: tuple[list, list] = ([], [])
    for i in range(len(cid) if best else 0):
        agree = (sig == sig[i]).sum(axis=1)
        may = (agree >= least) & (np.minimum(n, n[i]) >= threshold * np.maximum(n, n[i])) & (label != label[i]) & ((side != side[i]) | (side[i] == 0))
        if may.any():
            j = int(np.argmax(np.where(may, agree, -1)))
            out[0].append(cid[min(i, j)])
            out[1].append(cid[max(i, j)])
    for i in range(0 if best else len(cid) - 1):
        near = (sig[i + 1 :] == sig[i]).sum(axis=1) >= least
        near &= (np.minimum(n[i + 1 :], n[i]) >= threshold * np.maximum(n[i + 1 :], n[i])) & (label[i + 1 :] != label[i])
        for j in np.flatnonzero(near) + i + 1:
            met = tree and ((first[i] == first[j]) & whole[i]).any()  # in an earlier tree, in a node compared whole
            if not met and cid[i] != cid[j] and (side[i] != side[j] or side[i] == 0):
                out[0].append(cid[i])
                out[1].append(cid[j])
    return out


def _by_node(keys: int, each):
    """Over rows in order of their first columns, the keys: what each(rows of one key) gives."""

    def run(batches):
        drop_held()
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            own = list(zip(*(batch.column(i).to_pylist() for i in range(keys)), strict=True))
            at = 0
            while at < len(own):
                end = at + 1
                while end < len(own) and own[end] == own[at]:
                    end += 1
                if held and own[at] != key:
                    yield from each(pa.Table.from_batches(held))
                    held = []
                key = own[at]
                held.append(batch.slice(at, end - at))
                at = end
        if held:
            yield from each(pa.Table.from_batches(held))

    return run


def _met(leaves: DataFrame, threshold: float) -> DataFrame:
    """a, b and block, the node where they met, of each set and its likeliest partner."""

    def each(rows):
        a, b = _pairs_of(rows, threshold, True)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array([rows["node"][0].as_py()] * len(a), pa.int64())], names=["a", "b", "block"])

    rows = leaves.select("node", "cid", "n", "first", "sig", "label", "side", "tree", "big").repartition("node").sortWithinPartitions("node")
    return rows.mapInArrow(_by_node(1, each), "a binary, b binary, block long").groupBy("a", "b").agg(F.min("block").alias("block"))


def _all_links(scratch: Scratch, leaves: DataFrame, classes: DataFrame, docs: DataFrame, threshold: float, k: int) -> DataFrame:
    """All confirmed links within nodes. Candidates live in the task that confirms them and are never rows of their own,
    so that what travels follows the sets and not their pairs."""

    def partners(rows):
        a, b = _pairs_of(rows, threshold, False)
        if a:
            own = sorted({*a, *b})
            yield pa.RecordBatch.from_arrays([pa.array([rows["node"][0].as_py()] * len(own), pa.int64()), pa.array(own, pa.binary())], names=["node", "cid"])

    def confirmed(rows):
        a, b = _pairs_of(rows, threshold, False)
        items = dict(zip(rows["cid"].to_pylist(), (x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in rows["items"]), strict=True))
        whole, at = rows["chunks"][0].as_py() == 1, 0
        while at < len(a):
            end = at + 1
            while end < len(a) and a[end] == a[at]:
                end += 1
            both, either = _overlap(items[a[at]], [items[x] for x in b[at:end]])
            keep = np.flatnonzero(100 * both >= round(threshold * 100) * either if whole else np.ones(len(both), bool))
            if len(keep):
                yield pa.RecordBatch.from_arrays([pa.array([a[at]] * len(keep), pa.binary()), pa.array([b[at + i] for i in keep], pa.binary()), pa.array(both[keep]), pa.array(either[keep])], names=["a", "b", "both", "either"])
            at = end

    columns = ["node", "cid", "n", "first", "sig", "label", "side", "tree", "big"]
    tokens = classes.select("cid", "n", "first", "sig")
    nodes = leaves.join(tokens, "cid").select(columns).repartition("node").sortWithinPartitions("node")
    uses = scratch.cut(nodes.mapInArrow(_by_node(1, partners), "node long, cid binary").distinct().join(leaves, ["node", "cid"]).join(classes.select("cid", "n", "first", "sig", "doc"), "cid"))
    chunks = uses.groupBy("node").agg(F.ceil(F.sum("n") / HELD).cast("int").alias("chunks"))
    sets = full_sets(matching(docs.select("doc_id", "text"), scratch.cut(uses.select(F.col("doc").alias("doc_id")).distinct()), "doc_id"), k).dropDuplicates(["cid"])
    rows = uses.join(chunks, "node").join(sets, "cid").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("node", "chunk", *columns[1:], "chunks", _chunk_of("items").alias("items"))
    found = rows.repartition("node", "chunk").sortWithinPartitions("node", "chunk").mapInArrow(_by_node(2, confirmed), "a binary, b binary, both long, either long")
    # a pair that met in several nodes is summed as often on both sides, so the comparison holds
    edges = _reaching(scratch, found, threshold)
    scratch.drop(uses)
    return edges


def _overlap(own: np.ndarray, others: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the intersections and unions of a sorted set with each of others."""
    edge = np.cumsum([0, *map(len, others)])
    every = np.concatenate(others)
    hit = np.zeros(len(every) + 1, np.int64)
    if len(own):
        np.cumsum(own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every, out=hit[1:])
    both = hit[edge[1:]] - hit[edge[:-1]]
    return both, len(own) + np.diff(edge) - both


def _chunk_of(items: str):
    """The part of items in the row's chunk of chunks."""
    return F.when(F.col("chunks") == 1, F.col(items)).otherwise(F.filter(items, lambda h: F.pmod(h, F.col("chunks")) == F.col("chunk")))


def _reaching(scratch: Scratch, found: DataFrame, threshold: float) -> DataFrame:
    sums = found.groupBy("a", "b").agg(F.sum("both").alias("both"), F.sum("either").alias("either"))
    return scratch.cut(sums.where(F.lit(100) * F.col("both") >= F.lit(round(threshold * 100)) * F.col("either")).select("a", "b"))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows in order of block, chunk, kind and a: what the sets (kind 0: a, items) of each pair (kind 1: a, b) share."""
    held: dict[bytes, np.ndarray] = {}
    key = None
    for batch in batches:
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
        a, b, items = batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5)
        ends = np.concatenate([[0], np.cumsum(items.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        flat = items.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        out: tuple[list, list, list, list] = ([], [], [], [])
        at = 0
        while at < len(keys):
            if keys[at][:2] != key:
                key, held = keys[at][:2], {}
            if keys[at][2] == 0:
                held[a[at]] = flat[ends[at] : ends[at + 1]].copy()
                at += 1
                continue
            end = at + 1
            while end < len(keys) and keys[end] == keys[at] and a[end] == a[at]:
                end += 1
            both, either = _overlap(held[a[at]], [held[x] for x in b[at:end]])
            for c, v in zip(out, (a[at:end], b[at:end], both.tolist(), either.tolist()), strict=True):
                c += v
            at = end
        kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, kinds, strict=True)], names=["a", "b", "both", "either"])


def _verified(scratch: Scratch, pairs: DataFrame, classes: DataFrame, docs: DataFrame, threshold: float, k: int) -> DataFrame:
    """The pairs (a, b, block) whose full sets reach the threshold.

    A set goes once to each block that has pairs of it, not once to each pair. Blocks of more than HELD shingles are
    cut into chunks by shingle; what two sets share is the sum over the chunks.
    """
    uses = scratch.cut(pairs.select("block", F.explode(F.array("a", "b")).alias("cid")).distinct().join(classes.select("cid", "n", "doc"), "cid"))
    chunks = uses.groupBy("block").agg(F.ceil(F.sum("n") / HELD).cast("int").alias("chunks"))
    each = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")
    sets = full_sets(matching(docs.select("doc_id", "text"), scratch.cut(uses.select(F.col("doc").alias("doc_id")).distinct()), "doc_id"), k)
    sets = uses.select("block", "cid").join(chunks, "block").join(sets, "cid").select("block", "chunks", each, F.lit(0).alias("kind"), F.col("cid").alias("a"), F.lit(None).cast("binary").alias("b"), "items")
    asked = pairs.join(chunks, "block").select("block", each, F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("array<long>").alias("items"))
    rows = sets.withColumn("items", _chunk_of("items")).drop("chunks").unionByName(asked)
    found = rows.repartition("block", "chunk").sortWithinPartitions("block", "chunk", "kind", "a").mapInArrow(_shared, "a binary, b binary, both long, either long")
    edges = _reaching(scratch, found, threshold)
    scratch.drop(uses)
    return edges


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """cid and root, the smallest cid that it reaches, of all in edges (a, b): large-star and small-star steps.

    Each round is written once and the round before it deleted; the count and digest that tell whether a round changed
    anything are read from what was written.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")

    def state(x: DataFrame):
        return x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    e = scratch.cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    seen = state(e)
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u != v").distinct()
        last, e = e, scratch.cut(small)
        scratch.drop(last)
        release(edges.sparkSession)
        now = state(e)
        if now == seen:
            return e.select(F.col("u").alias("cid"), F.col("v").alias("root")).union(e.select(F.col("v").alias("cid"), F.col("v").alias("root")).distinct())
        seen = now


def _children(rows: DataFrame, level: int) -> DataFrame:
    """node, tree, cid, label of rows of large nodes (with sig), each sent on by BRANCH more tokens of its tree.

    Each node draws its own from those of the level, so that what one node parts may stay together in another.
    """
    many = (T - 1) // (LEVELS - 1)
    coords = F.array(*[F.array(*[F.lit(int(c)) for c in _ORDER[t][many * (level - 1) : many * level]]) for t in range(TREES)])
    start, step = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(many)), 1 + F.pmod(F.xxhash64("node", F.lit(2)), F.lit(many - 1))
    drawn = F.array(*[F.get(F.get(coords, "tree"), F.pmod(start + i * step, F.lit(many)).cast("int")) for i in range(BRANCH)])
    more = rows.withColumn("c", F.explode(drawn))
    return more.select(F.xxhash64("node", "c", F.get("sig", "c")).alias("node"), "tree", "cid", "label")


def _open(rows: DataFrame, *more) -> DataFrame:
    """Rows of nodes that hold two labels or more, with the node's size and what else is asked for."""
    nodes = rows.groupBy("node").agg(F.count("*").alias("size"), F.min("label").alias("l0"), F.max("label").alias("l1"), *more)
    return rows.join(nodes.where("l0 != l1").drop("l0", "l1"), "node")


def _stars(scratch: Scratch, rows: DataFrame, attrs: DataFrame, threshold: float) -> DataFrame:
    """For each set in nodes of more than STAR, the likeliest link to the smallest set of one of them."""
    likely, agree = _similar(threshold)
    pairs = rows.where(f"size > {STAR} and cid != pivot").select("cid", "pivot").distinct()
    pairs = pairs.join(attrs, "cid").join(attrs.toDF("pivot", "n_b", "sig_b"), "pivot").where(likely)
    best = scratch.cut(pairs.groupBy("cid").agg(F.max(F.struct(agree.alias("agree"), "pivot")).alias("best")).select("cid", "best.pivot"))
    parts = best.groupBy("pivot").agg(F.ceil(F.count("*") / (LEAF // 2)).alias("parts"))
    block = F.xxhash64("pivot", F.pmod(F.xxhash64("cid"), F.col("parts")))
    return best.join(parts, "pivot").select(F.col("pivot").alias("a"), F.col("cid").alias("b"), block.alias("block"))


def link(docs: DataFrame, threshold: float = 0.75, k: int = 5, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(signed, edges): every row's doc_id, cid and n; and the confirmed links between different sets.

    Between the levels rows are narrow (node, tree, cid, label); tokens are joined to what is left of them. Both results
    are tables of scratch, which the caller closes after them.
    """
    scratch = scratch or Scratch(docs.sparkSession, "links")
    whole = scratch.cut(signatures(docs, k))
    signed = scratch.cut(whole.select("doc_id", "cid", "n"))
    firsts = signed.where("n > 0 and doc_id is not null").groupBy("cid", "n").agg(F.min("doc_id").alias("doc"))
    tokens = whole.select(F.col("cid").alias("own"), "doc_id", "first", "sig")
    classes = scratch.cut(firsts.join(tokens, (F.col("cid") == F.col("own")) & (F.col("doc") == F.col("doc_id"))).select("cid", "n", "doc", "first", "sig").dropDuplicates(["cid"]))
    scratch.drop(whole)
    attrs = classes.select("cid", "n", "sig")

    roots = classes.select("cid", F.posexplode("first").alias("tree", "token"))
    rows = roots.select(F.xxhash64("tree", "token").alias("node"), "tree", "cid", F.xxhash64("cid").alias("label"))
    rows = scratch.cut(_open(rows, F.min("cid").alias("pivot")))

    linked = None
    stars = scratch.cut(_stars(scratch, rows, attrs, threshold))
    if not stars.isEmpty():
        linked = _verified(scratch, stars, classes, docs, threshold, k)
        known = components(linked, scratch)
        renamed = rows.drop("label", "size", "pivot").join(known, "cid", "left").select("node", "tree", "cid", F.xxhash64(F.coalesce("root", "cid")).alias("label"))
        last, rows = rows, scratch.cut(_open(renamed))
        scratch.drop(last)
    scratch.drop(stars)

    kept = ["node", "tree", "cid", "label"]
    large = rows.where(F.col("size") > LEAF)
    big = large.groupBy("cid").agg(F.sum(F.expr("shiftleft(1, tree)")).alias("big"))
    leaves = rows.where(F.col("size") <= LEAF).select(*kept, F.lit(0).alias("side")).join(big, "cid", "left").withColumn("big", F.coalesce("big", F.lit(0).cast("long")))
    kept += ["side", "big"]
    leaves = leaves.select(kept)
    deeper = lambda df: df.withColumns({"tree": F.lit(0), "big": F.lit(0).cast("long")})  # noqa: E731  each pair is reported
    levels = [rows]
    for level in range(1, LEVELS):
        if large.isEmpty():
            break
        rows = scratch.cut(_open(_children(large.join(attrs, "cid"), level)))
        levels.append(rows)
        leaves = leaves.unionByName(deeper(rows.where(F.col("size") <= LEAF).withColumn("side", F.lit(0))).select(kept))
        large = rows.where(F.col("size") > LEAF)
    else:
        leaves = leaves.unionByName(deeper(_blocks(large)).select(kept))

    # Sets of large groups first follow their likeliest links; only pairs of what those leave apart are compared in full.
    leaves, tokens = scratch.cut(leaves), classes.select("cid", "n", "first", "sig")
    scratch.drop(*levels)
    release(docs.sparkSession)
    for _ in range(ROUNDS):
        likely = scratch.cut(_met(leaves.join(tokens, "cid"), threshold))
        if likely.isEmpty():
            break
        found = _verified(scratch, likely, classes, docs, threshold, k)
        scratch.drop(likely)
        linked = found if linked is None else linked.union(found)
        known = components(linked, scratch)
        renamed = leaves.drop("label").join(known, "cid", "left").withColumn("label", F.xxhash64(F.coalesce("root", "cid"))).select(kept)
        last, leaves = leaves, scratch.cut(_open(renamed).select(kept))
        scratch.drop(last)
        release(docs.sparkSession)

    edges = _all_links(scratch, leaves, classes, docs, threshold, k)
    scratch.drop(leaves, classes)
    return signed, edges if linked is None else edges.union(linked)


def _blocks(large: DataFrame) -> DataFrame:
    """Nodes that no level parts, as pairs of blocks of about half a LEAF: every two sets meet in one node."""
    n = F.ceil(F.col("size") / (LEAF // 2)).cast("int")
    own = F.pmod(F.xxhash64("cid"), n).cast("int")
    dealt = large.withColumn("blocks", n).withColumn("own", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return dealt.withColumn("side", side).withColumn("node", F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other"))).drop("blocks", "own", "other")


def near_duplicates(docs: DataFrame, threshold: float = 0.75, k: int = 5) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest doc_id of its group), kept.

    doc_id is to be an integer number; other columns, whatever their names, are ignored. The result is written before it
    is returned, and everything that led to it is deleted.
    """
    scratch = Scratch(docs.sparkSession, "near")
    try:
        signed, edges = link(docs, threshold, k, scratch)
        roots = components(edges, scratch)
        first = signed.where("n > 0 and doc_id is not null").groupBy("cid").agg(F.min("doc_id").alias("doc"))
        found = roots.join(first, "cid")
        lowest = found.groupBy("root").agg(F.min("doc").alias("low"))
        grouped = first.join(found.join(lowest, "root").select("cid", "low"), "cid", "left").select("cid", F.coalesce("low", "doc").alias("low"))
        alone = (F.col("n") == 0) | F.col("doc_id").isNull()
        rows = signed.where(~alone).join(grouped, "cid").select("doc_id", "n", F.col("low").alias("component_id"))
        rows = rows.union(signed.where(alone).select("doc_id", "n", F.col("doc_id")))
        return cut(rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")))
    finally:
        scratch.close()
