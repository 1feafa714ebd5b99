"""SimHash near-duplicates by the generalised pigeonhole principle.

If two fingerprints differ in at most R bits, and the bits are dealt to m partitions with
thresholds t_i that satisfy ``sum(t_i + 1) = R + 1``, then in some partition they differ in at most t_i
bits (t_i = -1: the partition is not probed). Correlated bits go to the same partition, so that
the partitions are more independent. Dynamic programming chooses the thresholds, and the
number of partitions, with the least estimated cost of probes and candidate pairs; at larger inputs this
moves to fewer and wider partitions, so candidates do not grow with the square of the input.

Buckets of more than HOT fingerprints or so are split: the bits outside the bucket's key are dealt to R + 1 pieces, one of which
must be equal for a pair within R, and joins the key. This repeats until no bucket is large, and
loses no pair. Inside a bucket fingerprints are compared exactly. A task holds one forest over all its buckets and
gives one row for each fingerprint that it linked, whatever the number of links; equal rows of different tasks are one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, stage, table
from ..operators.graph import components

BITS = 64
SEED = 42
#: Buckets with more comparisons than of so many fingerprints with each other are split.
HOT = 6000
#: Keys of such buckets up to which they are broadcast; beyond they are joined by a shuffle.
MAX_BROADCAST_KEYS = 20_000
#: Estimated cost of a probe row, in comparisons of two fingerprints.
ROW_COST = 20.0
MAX_PARTITIONS = 6
#: Keys over which the partitions' bit counts are added, first by partition, then before the driver gets them.
SUM_KEYS = (1024, 16)
#: Linked fingerprints that a task's forest holds before it gives them out and starts another.
FOREST_NODES = 500_000


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 of each k-word shingle of the text, A-Z in lower case; fewer words make one shingle, no word none."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z, and blanks are the six of ASCII
    if not words:
        return np.empty(0, dtype=np.uint64)
    h, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) < k:
        return np.array([h(join(words), SEED)], dtype=np.uint64)
    n = len(words) - k + 1
    return np.fromiter((h(join(s), SEED) for s in zip(*(words[i : i + n] for i in range(k)), strict=True)), dtype=np.uint64, count=n)


_LANES = np.uint64(0x0101010101010101)


def majorities(hashes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The fingerprints, as signed 64-bit numbers, of the texts with the hashes from start to stop: bits that are set in over half of them.

    Bit k of all eight bytes is counted at once, in byte lanes that are added up before they can overflow. Hashes between
    one text's stop and the next one's start must be 0 and fewer than 56.
    """
    n, out = stop - start, np.zeros(len(start), dtype=np.int64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    blocks = -(-n[some] // 200)
    first = np.cumsum(blocks) - blocks
    at = np.repeat(start[some] - 200 * first, blocks) + 200 * np.arange(blocks.sum())
    total = np.empty((len(some), 8, 8), dtype=np.int64)  # byte, bit in its byte
    part = hashes[: stop[some[-1]]]
    for k in range(8):
        lanes = np.add.reduceat((part >> np.uint64(k)) & _LANES, at)
        total[:, :, k] = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
    bits = 2 * total.reshape(-1, BITS) > n[some, None]
    out[some] = np.packbits(bits, axis=1, bitorder="little").view("<i8").ravel()
    return out


def majority(hashes: np.ndarray) -> int:
    return int(majorities(hashes, np.zeros(1, np.int64), np.array([len(hashes)]))[0])


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """docs (doc_id, text; other columns are ignored) to (doc_id, fp); null and blank texts have 0."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = [majority(shingle_hashes(t, k)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, fp long")


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have both bits i and j, added up by partitions."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            v = b.column("fp").to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(v, axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(bits)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % SUM_KEYS[0]]), pa.array([n]), pa.array([total.tobytes()], pa.binary())], ["k", "n", "m"])

    def add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [int(key[0]) % SUM_KEYS[1]], "n": [group["n"].sum()], "m": [sum(np.frombuffer(m) for m in group["m"]).tobytes()]})

    parts = fps.select("fp").mapInArrow(count, "k long, n long, m binary")
    for _ in SUM_KEYS:
        parts = parts.groupBy("k").applyInPandas(add, "k long, n long, m binary")
    parts = parts.collect()
    return sum(p["n"] for p in parts), sum((np.frombuffer(p["m"]) for p in parts), np.zeros(BITS * BITS)).reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """Bits dealt to m partitions of nearly equal size, correlated bits together (greedily, from the strongest pair)."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, -1)
    left, out = set(range(BITS)), []
    for i in range(m):
        size = BITS // m + (i < BITS % m)
        idx = sorted(left)
        a, b = np.unravel_index(np.argmax(corr[np.ix_(idx, idx)]), (len(idx), len(idx))) if len(idx) > 1 else (0, 0)
        part = list(dict.fromkeys([idx[a], idx[b]]))[:size]
        while len(part) < size:
            part.append(max(left - set(part), key=lambda x: (corr[x, part].mean(), -x)))
        out.append(sorted(part))
        left -= set(part)
    return out


def allocate(n: int, p: np.ndarray, groups: list[list[int]], radius: int) -> tuple[float, list[int]]:
    """Estimated cost and thresholds of the partitions with sum(t + 1) = radius + 1, by dynamic programming.

    A partition's candidates at threshold t are the pairs that differ in at most t of its bits, estimated from the bits'
    frequencies; its probes are the keys within t of each fingerprint.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for g in groups:
        dist = np.ones(1)
        for b in g:
            agree = p[b] ** 2 + (1 - p[b]) ** 2
            dist = np.convolve(dist, [agree, 1 - agree])
        cost = [0.0]
        for t in range(min(radius, len(g)) + 1):
            probes = sum(comb(len(g), r) for r in range(t + 1))
            cost.append(float(n) ** 2 / 2 * dist[: t + 1].sum() * (1 if t == 0 else 2) + ROW_COST * n * probes)
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for t1, extra in enumerate(cost):
                if used + t1 <= radius + 1 and (used + t1 not in step or c + extra < step[used + t1][0]):
                    step[used + t1] = (c + extra, [*ts, t1 - 1])
        best = step
    return best.get(radius + 1, (float("inf"), []))


def plan_partitions(fps: DataFrame, radius: int) -> list[tuple[int, int]]:
    """(bit mask, threshold) of each partition that is probed."""
    n, both = bit_counts(fps)
    p = np.diag(both) / max(n, 1)
    options = []
    for m in range(1, MAX_PARTITIONS + 1):
        groups = group_bits(n, both, m)
        cost, ts = allocate(n, p, groups, radius)
        if ts:
            options.append((cost, [(sum(1 << b for b in g), t) for g, t in zip(groups, ts, strict=True) if t >= 0]))
    return min(options)[1]


def signed(x: int) -> int:
    x &= (1 << BITS) - 1
    return x - (1 << BITS) if x >> (BITS - 1) else x


def flips(mask: int, t: int) -> list[int]:
    """Masks of up to t bits of the partition, the empty one first."""
    bits = [1 << b for b in range(BITS) if mask >> b & 1]
    return [sum(c) for r in range(t + 1) for c in combinations(bits, r)]


def submasks(mask: int, pieces: int) -> list[int]:
    """The bits outside mask dealt to that many pieces, each joined to mask; all bits if there are fewer left."""
    rest = [b for b in range(BITS) if not mask >> b & 1]
    if len(rest) < pieces:
        return [(1 << BITS) - 1]
    return [mask | sum(1 << b for b in rest[i::pieces]) for i in range(pieces)]


def buckets(fps: DataFrame, parts: list[tuple[int, int]], radius: int, hot: int = HOT) -> DataFrame:
    """(mask, value, fp, probe) rows: fingerprints within radius share a (mask, value) at least once, one of them unprobed.

    Buckets with more than hot * hot comparisons are split by further equal pieces until none is left.
    """
    rows = None
    for mask, t in parts:
        each = fps.select(F.lit(signed(mask)).alias("mask"), "fp", F.explode(F.array(*[F.lit(signed(x)) for x in flips(mask, t)])).alias("flip"))
        rows = each if rows is None else rows.unionByName(each)
    rows = rows.withColumn("value", (F.col("fp").bitwiseXOR(F.col("flip"))).bitwiseAND(F.col("mask")))
    if all(t == 0 for _, t in parts):
        rows = rows.withColumn("flip", F.lit(0).cast("long"))
    done = []

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mask, fp, flip = (b.column(c).to_numpy() for c in ("mask", "fp", "flip"))
            for m in np.unique(mask):
                at = mask == m
                for sub in submasks(int(m) & ((1 << BITS) - 1), radius + 1):
                    sub = np.int64(signed(sub))
                    cols = (np.full(at.sum(), sub), (fp[at] ^ flip[at]) & sub, fp[at], flip[at])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["mask", "value", "fp", "flip"])

    rows = rows.select("mask", "value", "fp", "flip")
    while True:
        plain = F.count_if(F.col("flip") == 0)
        full = rows.groupBy("mask", "value").agg((plain * F.count("*")).alias("n")).filter((F.col("n") > hot * hot) & (F.col("mask") != -1))
        full = stage(full.select(F.col("mask").alias("m"), F.col("value").alias("v")), "hot")
        n_full = full.count()
        if not n_full:
            done.append(rows)
            break
        same = (F.col("mask") == F.col("m")) & (F.col("value") == F.col("v"))
        few = F.broadcast(full) if n_full <= MAX_BROADCAST_KEYS else full
        done.append(rows.join(few, same, "left_anti"))
        parted = rows.join(few, same, "left_semi").mapInArrow(split, "mask long, value long, fp long, flip long")
        rows = stage(parted.distinct(), "split")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("mask", "value", "fp", (F.col("flip") != 0).alias("probe"))


def popcount(v: np.ndarray) -> np.ndarray:
    return np.bitwise_count(v.view(np.uint64))


def close_pairs(mask: np.ndarray, value: np.ndarray, fp: np.ndarray, probe: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of one bucket (rows sorted by mask, value and probe), one of them unprobed, within radius and not equal."""
    a_out, b_out, step = [], [], 1
    live = np.flatnonzero(~probe)
    while len(live):
        live = live[live + step < len(fp)]
        live = live[(mask[live] == mask[live + step]) & (value[live] == value[live + step])]
        d = popcount(fp[live] ^ fp[live + step])
        hit = live[(d <= radius) & (d > 0)]
        a_out.append(hit)
        b_out.append(hit + step)
        step += 1
    return (np.concatenate(a_out), np.concatenate(b_out)) if a_out else (np.empty(0, np.int64), np.empty(0, np.int64))


def _sorted_runs(batches: Iterator[pa.RecordBatch], names: tuple[str, ...] = ("mask", "value", "fp", "probe"), keys: int = 2) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of rows sorted by the first keys of them, in blocks that end where a bucket ends."""
    held: list[tuple[np.ndarray, ...]] = []
    for b in batches:
        cols = tuple(b.column(c).to_numpy(zero_copy_only=False) for c in names)
        if not len(cols[0]):
            continue
        other = np.flatnonzero(np.any([c != c[-1] for c in cols[:keys]], axis=0))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut == 0 and held and all(h[-1] == c[0] for h, c in zip(held[-1][:keys], cols[:keys], strict=True)):
            held.append(cols)
            continue
        held.append(tuple(c[:cut] for c in cols))
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
        held = [tuple(c[cut:] for c in cols)]
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def spanning_pairs(mask: np.ndarray, value: np.ndarray, fp: np.ndarray, probe: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of those of the close_pairs that join what was not yet joined.

    Pairs of one component are left out as they are found, so a dense bucket takes memory for its rows only.
    """
    names, node = np.unique(fp, return_inverse=True)
    over = np.arange(len(names))
    a_out, b_out, step = [], [], 1
    live = np.flatnonzero(~probe)
    while len(live):
        live = live[live + step < len(fp)]
        live = live[(mask[live] == mask[live + step]) & (value[live] == value[live + step])]
        d = popcount(fp[live] ^ fp[live + step])
        hit = live[(d <= radius) & (d > 0)]
        a, b = node[hit], node[hit + step]
        apart = over[a] != over[b]
        for x, y in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
            r, t = x, y
            while over[r] != r:
                r = over[r]
            while over[t] != t:
                t = over[t]
            if r != t:
                over[max(r, t)] = min(r, t)
                a_out.append(min(x, y))
                b_out.append(max(x, y))
        while apart.any() and (over[over] != over).any():
            over = over[over]
        step += 1
    return names[np.array(a_out, np.int64)], names[np.array(b_out, np.int64)]


class Forest:
    """Fingerprints that links join, with the smallest of their component and the first smaller one that each was linked to."""

    def __init__(self) -> None:
        self.over: dict[int, int] = {}
        self.near: dict[int, int] = {}

    def top(self, x: int) -> int:
        over = self.over
        while (up := over.setdefault(x, x)) != x:
            over[x] = x = over[up]
        return x

    def link(self, a: int, b: int) -> None:
        r, t = self.top(a), self.top(b)
        if r != t:
            self.over[max(r, t)] = min(r, t)
        self.near.setdefault(max(a, b), min(a, b))

    def rows(self) -> pa.RecordBatch:
        """node, root and near of each node that isn't the smallest; near is the node's own link, or the root where it was never the greater end."""
        nodes = [x for x in self.over if self.top(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (nodes, [self.top(x) for x in nodes], [self.near.get(x, self.top(x)) for x in nodes])], ["node", "root", "near"])


def _compared(fps: DataFrame, radius: int, hot: int) -> DataFrame:
    rows = buckets(fps, plan_partitions(fps, radius), radius, hot)
    return rows.repartition("mask", "value").sortWithinPartitions("mask", "value", "probe")


def links(fps: DataFrame, radius: int = 3, hot: int = HOT) -> DataFrame:
    """(a, b), a < b: every link between different fingerprints of fps (fp, distinct) at radius bits or fewer, once or more."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for mask, value, fp, probe in _sorted_runs(batches):
            i, j = close_pairs(mask, value, fp, probe, radius)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(fp[i], fp[j])), pa.array(np.maximum(fp[i], fp[j]))], ["a", "b"])

    return _compared(fps, radius, hot).mapInArrow(compare, "a long, b long")


def forest(fps: DataFrame, radius: int = 3, hot: int = HOT) -> DataFrame:
    """node, root, near: for each fingerprint of fps (fp, distinct) that a task linked, the smallest of its component in that task, and one
    to which it is linked directly.

    (node, root) connect the same components as all links at radius bits or fewer do. No fingerprint, no row.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = Forest()
        for mask, value, fp, probe in _sorted_runs(batches):
            for a, b in zip(*(x.tolist() for x in spanning_pairs(mask, value, fp, probe, radius)), strict=True):
                trees.link(a, b)
            if len(trees.over) > FOREST_NODES:
                yield trees.rows()
                trees = Forest()
        yield trees.rows()

    return _compared(fps, radius, hot).mapInArrow(compare, "node long, root long, near long")


def near_duplicates(docs: DataFrame, k: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fp and component_id for each row of docs (doc_id, text; other columns are ignored).

    component_id is the smallest doc_id among the documents that a chain of links reaches; equal fingerprints are
    linked, also those of texts without words (0). A null doc_id never names a component unless there is no other.
    """
    each = stage(fingerprints(docs, k), "fingerprints")
    fps = stage(each.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    comps = components(forest(fps.select("fp"), radius).select(F.col("node").alias("a"), F.col("root").alias("b")).distinct())
    joined = fps.join(comps.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    low = joined.groupBy("label").agg(F.min("first").alias("component_id"))
    named = stage(joined.join(low, "label").select("fp", "component_id"), "components")
    return each.join(named, "fp").select("doc_id", "fp", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
