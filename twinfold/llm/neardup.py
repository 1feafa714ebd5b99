"""Near-duplicate documents: SimHash groups, verified by Jaccard similarity, completed without misses.

Documents are linked if the Jaccard similarity of their sets of word shingles reaches a limit; groups are chains of links.

1. Documents with equal sets form a class; its smallest id stands for it.
2. The classes' fingerprints (of shorter shingles, which survive more edits) are linked by the generalised pigeonhole of simhash.
   Each linked fingerprint is verified against the one it was linked to and against the smallest of its group; what passes joins classes to parts.
3. What fingerprints miss is found by prefixes: of two similar sets in one order of all hashes, the first
   n - ceil(similarity * n) + 1 hashes of each have one in common. Only hashes that stand in several parts matter. At first each
   document is verified against one document of another part by shared hash, which joins nearly all of
   a group of copies in a few pairs a document; then all pairs of different parts that share a hash and whose sizes and places allow
   the similarity are verified. Pairs are first tested by sketches, which bound the difference of two sets from below, and
   then by the sets themselves. The second step makes the result exact: the links don't depend on the fingerprints, the
   order of the hashes or the table's size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property, lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, slices, stage
from .simhash import _sorted_runs, forest, majorities
from ..operators.graph import components

#: Punctuation that is cut off both ends of a word.
PUNCTUATION = b".,;:!?\"'()[]{}|*#$%&"
#: Words in a fingerprint's shingle, and bits within which fingerprints are linked.
FINGERPRINT_WORDS, RADIUS = 2, 7
#: Ids up to which a set of documents is broadcast; beyond it is joined by a shuffle.
MAX_BROADCAST_IDS = 100_000
#: Shared hashes up to which they are broadcast.
MAX_BROADCAST_SHARED = 200_000
#: Hashes that so many sets and this share of the sets of a stretch of documents hold go to the end of the order, the most frequent
#: MAX_LATE of them at most. Any order finds every pair; this only saves comparisons.
LATE, LATE_SHARE, MAX_LATE = 8, 0.001, 100_000
#: Low bits by which late hashes are told from others.
LATE_BITS = 22
#: Hashes that a task gathers before it counts them.
COUNTED = 1 << 20
#: Rows of an Arrow batch of pairs of sets.
PAIR_ROWS = 200
#: Documents that share a hash beyond which they are compared block by block.
BLOCK = 4096
#: Met pairs that a task holds before it gives them out.
PAIRS_HELD = 1 << 20
#: Rounds that verify one pair of each document with another part, before all remaining pairs.
ROUNDS = 2
#: Bytes of text that are hashed at a time.
CHUNK = 1 << 17
BASE = 0xD6E8FEB86659FD93
_M = np.uint64(0x9E3779B97F4A7C15)
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _powers(n: int, x: int) -> np.ndarray:
    """x to the power of 0 to n - 1, modulo 2 ** 64."""
    out = np.full(n, x, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


@lru_cache(2)
def _tables(n: int) -> tuple[np.ndarray, ...]:
    """Class of each byte (0: of a word, 1: blank, 2: punctuation), a random number for each, and powers and inverse powers of a base."""
    kind = np.zeros(256, dtype=np.uint8)
    kind[list(b" \t\n\v\f\r")] = 1
    kind[list(PUNCTUATION)] = 2
    value = np.random.default_rng(42).integers(0, 1 << 64, 256, dtype=np.uint64)
    return kind, value, _powers(n, BASE), _powers(n, pow(BASE, -1, 1 << 64))


def _hash_words(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in data (in lower case, without punctuation at their ends), and where each starts; n: bytes that tables are made for."""
    kind, value, power, inverse = _tables(n)
    x = np.frombuffer(data.lower(), dtype=np.uint8)
    k = kind[x]
    live = np.flatnonzero(k == 0)
    if not len(live):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    word = np.cumsum(k == 1)[live]
    new = np.flatnonzero(word[1:] != word[:-1]) + 1
    first, last = live[np.append(0, new)], live[np.append(new, len(live)) - 1] + 1
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value[x] * power[: len(x)], dtype=np.uint64)])
    h = (total[last] - total[first]) * inverse[first]
    h ^= h >> np.uint64(32)
    return h * _M, first


def word_chunks(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Texts i to j, some at a time: hashes of all their words in order, and the number of words before each text and in all."""
    i = 0
    while i < len(texts):
        parts, size, j = [], 0, i
        while j < len(texts) and (not parts or size < CHUNK):
            parts.append((texts[j] or "").encode())
            size += len(parts[-1]) + 1
            j += 1
        if size <= 2 * CHUNK:
            h, first = _hash_words(b" ".join(parts) + b" ", 2 * CHUNK)
            ends = np.searchsorted(first, np.cumsum([0, *(len(x) + 1 for x in parts)]))
        else:  # a long text comes last: the others first, then it in stretches that end at a blank
            found = [_hash_words(b" ".join(parts[:-1]) + b" ", 2 * CHUNK)]
            ends = np.searchsorted(found[0][1], np.cumsum([0, *(len(x) + 1 for x in parts[:-1])]))
            long, at = parts[-1], 0
            while at < len(long):
                cut = _BLANK.search(long, at + CHUNK)
                stop = cut.end() if cut else len(long)
                found.append(_hash_words(long[at:stop], 1 << max(2 * CHUNK, stop - at).bit_length()))
                at = stop
            h = np.concatenate([x for x, _ in found])
            ends = np.append(ends, len(h))
        yield i, j, h, ends
        i = j


def shingles(h: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the shingles of k words of texts with words h, cut at ends; where each text's start and stop.

    Fewer words make one shingle, none make none. What stands between the texts' shingles is 0.
    """
    n, start, words = len(h), ends[:-1], np.diff(ends)
    out = np.zeros(n, dtype=np.uint64)
    if n >= k:
        x = h[: n - k + 1] * _M
        for i in range(1, k):
            x = (x + h[i : n - k + 1 + i]) * _M
        out[: n - k + 1] = x
    for t in np.flatnonzero((words > 0) & (words < k)):
        x = np.uint64(0)
        for w in h[ends[t] : ends[t + 1]]:
            x = np.multiply(np.add(x, w), _M)
        out[ends[t]] = x
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xC2B2AE3D27D4EB4F)
    out ^= out >> np.uint64(32)
    stop = start + np.where(words >= k, words - k + 1, np.minimum(words, 1))
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, stop, -1)
    out[np.cumsum(edge[:-1]) == 0] = 0
    return out, start, stop


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles."""
    for _, _, h, ends in word_chunks(texts):
        x, start, stop = shingles(h, ends, k)
        for a, b in zip(start.tolist(), stop.tolist(), strict=True):
            yield np.unique(x[a:b])


def shingle_set(text: str | None, k: int) -> np.ndarray:
    return next(shingle_sets([text], k))


class Order:
    """An order of all hashes: rising, those of late after all others by their rank."""

    def __init__(self, late: np.ndarray, rank: np.ndarray):
        at = np.argsort(late)
        self.late, self.rank = late[at], rank[at]

    @cached_property
    def maybe(self) -> np.ndarray:
        """Whether a late hash has these low bits; most others are told apart by them."""
        out = np.zeros(1 << LATE_BITS, dtype=bool)
        out[self.late & np.uint64(len(out) - 1)] = True
        return out

    def split(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is late, and the ranks of those that are."""
        is_late = self.maybe[s & np.uint64((1 << LATE_BITS) - 1)]
        where = np.flatnonzero(is_late)
        at = np.minimum(np.searchsorted(self.late, s[where]), len(self.late) - 1)
        hit = self.late[at] == s[where]
        is_late[where] = hit
        return is_late, self.rank[at[hit]]

    def prefix(self, s: np.ndarray, similarity: float) -> np.ndarray:
        """The first hashes of a sorted set: sets of at least that similarity share one of them."""
        n = len(s) - max(1, ceil(similarity * len(s) - 1e-9)) + 1
        if not len(self.late) or not len(s):
            return s[:n]
        for part in (s[: 2 * n], s):
            is_late, rank = self.split(part)
            first = part[~is_late]
            if len(first) >= n:
                return first[:n]
        return np.concatenate([first, s[is_late][np.argsort(rank, kind="stable")]])[:n]

    def __getstate__(self) -> dict:
        return {"late": self.late, "rank": self.rank}


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets' Jaccard similarity reaches the limit."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both)


def sketch(s: np.ndarray) -> bytes:
    """For each of about as many bins as the set has hashes, whether an odd number of them lies in it.

    Two sets' sketches differ in no more bins than the sets have hashes that are not common.
    """
    bins = 1 << max(6, (len(s) - 1).bit_length() if len(s) else 0)
    return np.packbits(np.bincount((s & np.uint64(bins - 1)).astype(np.int64), minlength=bins) & 1).tobytes()


def differ_at_least(x: bytes, y: bytes) -> int:
    """Hashes that two sets don't have in common, at least: bins that differ after the longer sketch is folded to the shorter."""
    a, b = (np.frombuffer(z, np.uint8) for z in (x, y))
    if len(a) != len(b):
        n = min(len(a), len(b))
        a, b = (np.bitwise_xor.reduce(z.reshape(-1, n)) for z in (a, b))
    return int(np.bitwise_count(a ^ b).sum())


def meeting_pairs(h: np.ndarray, part: np.ndarray, size: np.ndarray, pos: np.ndarray, own: np.ndarray, cross: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs with one h (rows sorted by h and size), of different parts, whose sizes and places allow the similarity.

    Where cross holds, only pairs of different own count.
    """
    a_out, b_out, held, step = [], [], 0, 1
    live = np.arange(len(h))
    while len(live):
        live = live[live + step < len(h)]
        live = live[(h[live] == h[live + step]) & (size[live] >= similarity * size[live + step])]
        o = live + step
        both = np.minimum(size[live] - pos[live], size[o] - pos[o])  # at most, if this is their first common hash
        hit = live[(part[live] != part[o]) & (~cross[live] | (own[live] != own[o])) & (both >= similarity * (size[live] + size[o] - both) - 1e-9)]
        a_out.append(hit)
        b_out.append(hit + step)
        held += len(hit)
        if held > PAIRS_HELD:
            yield np.concatenate(a_out), np.concatenate(b_out)
            a_out, b_out, held = [], [], 0
        step += 1
    if held:
        yield np.concatenate(a_out), np.concatenate(b_out)


def _few(df: DataFrame, n: int, most: int = MAX_BROADCAST_IDS) -> DataFrame:
    return F.broadcast(df) if n <= most else df


def _signed(x: int) -> int:
    return int(np.uint64(x).view(np.int64))


def looks(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, g and h (128 bits of the set's hash, or of the text of wordless documents), fp, empty; and heavy, in rows that stand for a stretch of documents."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "g", "h", "fp", "empty", "heavy"]

    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int64())])))

    def count(held: list[np.ndarray]) -> list[dict]:
        v, n = np.unique(np.concatenate(held), return_counts=True)
        at = n >= max(LATE, LATE_SHARE * len(held))
        return [{"h": x, "n": y} for x, y in zip(v[at].view(np.int64).tolist(), n[at].tolist(), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n_held, before = 0, None
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            out: tuple[list, ...] = ([], [], [], [], [])
            for i, j, h, ends in word_chunks(texts):
                x, start, stop = shingles(h, ends, shingle)
                fps = majorities(*shingles(h, ends, FINGERPRINT_WORDS))
                for t, a, e, fp in zip(range(i, j), start.tolist(), stop.tolist(), fps.tolist(), strict=True):
                    s = np.unique(x[a:e])
                    held.append(s)
                    n_held += len(s)
                    heavy = []
                    if n_held >= COUNTED:
                        heavy, held, n_held = count(held), [], 0
                    d = xxhash.xxh3_128_intdigest(s.tobytes(), 0) if len(s) else xxhash.xxh3_128_intdigest((texts[t] or "").encode(), 1)
                    for col, v in zip(out, (_signed(d >> 64), _signed(d & (1 << 64) - 1), fp, not len(s), heavy), strict=True):
                        col.append(v)
            if before:
                yield pa.RecordBatch.from_arrays([before[0], *(pa.array(x, k) for x, k in zip(before[1], kinds, strict=True))], names)
            before = (b.column("doc_id"), out) if b.num_rows else before
        if before:  # the last row stands for what is left
            before[1][4][-1] = [*before[1][4][-1], *count(held)] if held else before[1][4][-1]
            yield pa.RecordBatch.from_arrays([before[0], *(pa.array(x, k) for x, k in zip(before[1], kinds, strict=True))], names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, g long, h long, fp long, empty boolean, heavy array<struct<h:long,n:long>>")


def possible(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sketches (id, size, sketch) allow the similarity, as a written table; no similar pair is left out."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = (b.column(c).to_pylist() for c in ("na", "nb", "x", "y"))
            # both >= similarity * (na + nb - both) leaves na + nb - 2 * both hashes that are not common, at most
            ok = [differ_at_least(x, y) <= (n + m) * (1 - similarity) / (1 + similarity) + 1e-9 for n, m, x, y in zip(*cols, strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(sketches.toDF("b", "nb", "y"), "b").join(sketches.toDF("a", "na", "x"), "a").select("a", "b", "na", "nb", "x", "y")
    return stage(both.mapInArrow(test, "a long, b long"), "possible")


def verified(docs: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b: ids) whose sets reach the similarity, as a written table."""
    ids = stage(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "pairids")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([s.tobytes() for s in shingle_sets(b.column("text").to_pylist(), shingle)], pa.binary())], ["id", "s"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), similarity) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    with scratch():
        some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(_few(ids, ids.count()), "doc_id")
        sets = stage(some.select("doc_id", "text").mapInArrow(sets_of, "id long, s binary"), "pairsets")
        both = pairs.join(sets.toDF("b", "y"), "b").join(sets.toDF("a", "x"), "a").select("a", "b", "x", "y")
        return stage(both.mapInArrow(verify, "a long, b long"), "verified", outer=True, batch=PAIR_ROWS)


def _pairs(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def fingerprint_pairs(classes: DataFrame, radius: int) -> DataFrame:
    """(a, b): ids of classes to verify: each class with the first of its fingerprint, and this one with those of the fingerprint's near and root."""
    fps = stage(classes.groupBy("fp").agg(F.min("first").alias("rep")), "fps")
    trees = stage(forest(fps.select("fp"), radius).groupBy("node").agg(F.min("near").alias("near"), F.min("root").alias("root")), "trees")
    other = trees.select("node", F.explode(F.array_distinct(F.array("near", "root"))).alias("to"))
    across = other.join(fps.toDF("node", "a0"), "node").join(fps.toDF("to", "b0"), "to").select(*_pairs("a0", "b0"))
    same = classes.join(fps, "fp").filter("first <> rep").select(*_pairs("first", "rep"))
    return stage(across.union(same).distinct(), "fppairs")


def prefix_rows(docs: DataFrame, firsts: DataFrame, heavy: DataFrame, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """rows: id, size, pos, h of each document in firsts (id): the hashes of its prefix that stand in the prefix of another, too; sketches: id, size, sketch."""
    often = heavy.groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(MAX_LATE).toPandas()
    order = Order(often["h"].to_numpy(np.int64).view(np.uint64), -np.arange(len(often)))  # the most frequent last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sizes, first, sketches = [], [], []
            for s in shingle_sets(b.column("text").to_pylist(), shingle):
                sizes.append(len(s))
                first.append(order.prefix(s, similarity).copy())
                sketches.append(sketch(s))
            ends = np.cumsum([0, *map(len, first)])
            flat = np.concatenate(first).view(np.int64) if len(first) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), pa.array(sketches, pa.binary())], ["id", "size", "first", "sketch"])

    every = docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter("id is not null")
    written = stage(every.mapInArrow(run, "id long, size int, first array<long>, sketch binary"), "prefixes")
    rows = written.select("id", "size", "first").join(firsts, "id", "left_semi").select("id", "size", F.posexplode("first").alias("pos", "h"))
    shared = stage(rows.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "shared")
    return stage(rows.join(_few(shared, shared.count(), MAX_BROADCAST_SHARED), "h"), "sharedrows"), written.select("id", "size", "sketch").dropDuplicates(["id"])


def _with_parts(rows: DataFrame, parts: DataFrame | None) -> DataFrame:
    if parts is None:
        return rows.withColumn("part", F.col("id"))
    return rows.join(_few(parts, parts.count()), "id", "left").withColumn("part", F.coalesce("label", "id")).drop("label")


def one_pair_each(rows: DataFrame, parts: DataFrame | None, similarity: float) -> DataFrame:
    """(a, b): of each document and hash of its, one document of another part with this hash, the first by part or else the last, if sizes and places allow the similarity.

    No task has all rows of a hash.
    """
    rows = _with_parts(rows, parts)
    at = F.struct("part", "id", "size", "pos")
    ends = rows.groupBy("h").agg(F.min(at).alias("low"), F.max(at).alias("high")).filter("low.part <> high.part")
    to = F.when(F.col("part") != F.col("low.part"), F.col("low")).when(F.col("part") != F.col("high.part"), F.col("high"))
    met = rows.join(ends, "h").withColumn("to", to).filter("to is not null")
    both = F.least(F.col("size") - F.col("pos"), F.col("to.size") - F.col("to.pos"))
    near = F.least("size", "to.size") >= similarity * F.greatest("size", "to.size")
    met = met.filter(near & (both >= similarity * (F.col("size") + F.col("to.size") - both) - 1e-9))
    return met.select("id", F.col("to.id").alias("to")).select(*_pairs("id", "to")).distinct()


def all_pairs(rows: DataFrame, parts: DataFrame | None, similarity: float, block: int = BLOCK) -> DataFrame:
    """(a, b): all pairs of different parts that share a hash and whose sizes and places allow the similarity.

    A hash with more than block documents is compared by pairs of blocks of them, each in a task of its own.
    """
    rows = _with_parts(rows, parts)
    ends = rows.groupBy("h").agg(F.count("*").alias("n"), F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high")
    rows = rows.join(ends.select("h", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "h")
    own = F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))
    dealt = rows.withColumn("own", own).select("h", "id", "part", "size", "pos", "own", F.explode(cells).alias("c")).select("h", "c.i", "c.j", "id", "part", "size", "pos", "own")
    dealt = dealt.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "size")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, i, j, ids, part, size, pos, own in _sorted_runs(batches, ("h", "i", "j", "id", "part", "size", "pos", "own"), 3):
            cell = np.cumsum(np.concatenate([[0], (h[1:] != h[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
            for x, y in meeting_pairs(cell, part, size, pos, own, i != j, similarity):
                got = np.unique(np.stack([np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[1])], ["a", "b"])

    return dealt.mapInArrow(meet, "a long, b long").distinct()


def groups(docs: DataFrame, each: DataFrame, classes: DataFrame, shingle: int, similarity: float, radius: int = RADIUS, rounds: int = ROUNDS) -> DataFrame | None:
    """(id, label) of the classes (first, fp) that have a similar one; label is the smallest id of the group. None if there are none."""
    heavy = each.select(F.explode("heavy").alias("x")).select("x.h", "x.n")
    rows, sketches = prefix_rows(docs, classes.select(F.col("first").alias("id")), heavy, shingle, similarity)

    def links(pairs: DataFrame) -> DataFrame:
        return verified(docs, possible(pairs, sketches, similarity), shingle, similarity)

    def joined(parts: DataFrame | None, more: DataFrame) -> DataFrame:
        """The parts after more links; the parts' own links are stars already, so few rounds join them."""
        old = more if parts is None else parts.select(F.col("id").alias("a"), F.col("label").alias("b")).unionByName(more)
        return components(old).toDF("id", "label")

    pairs = fingerprint_pairs(classes, radius)
    edges = links(pairs)
    parts = None if edges.isEmpty() else joined(None, edges)
    last = False
    for turn in range(rounds + 1):
        last = last or turn == rounds
        met = all_pairs(rows, parts, similarity) if last else one_pair_each(rows, parts, similarity)
        met = stage(met.join(pairs, ["a", "b"], "left_anti"), "met")
        more = links(met)
        found = not more.isEmpty()
        if found:
            parts = joined(parts, more)
        if last:
            return parts
        pairs = stage(pairs.unionByName(met), "tried")
        last = not found  # another such round would find little more; the next one finds all
    return parts


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """The rows and columns of docs (doc_id integer, text, ...) without near-duplicates: the smallest doc_id of each group stays.

    Texts are linked if the Jaccard similarity of their sets of shingle-word shingles (words in lower case, without
    punctuation at the ends) is at least ``similarity``; every such pair is a link, at any size of the table. Groups are
    chains of links. Texts without words are linked only to equal ones; null counts as empty. Of rows with
    equal id and text one stays; ids are taken to be unique otherwise. Rows without an id are compared with no other
    and stay, equal ones once. An empty table stays empty; further columns of any name are kept as they are.
    """
    texts = docs.select("doc_id", "text")
    by = ["g", "h", "empty"]
    with scratch():
        each = stage(looks(texts, shingle), "looks")
        classes = stage(each.filter("doc_id is not null").groupBy(*by).agg(F.min("doc_id").cast("long").alias("first"), F.min("fp").alias("fp")), "classes")
        labels = groups(texts, each, classes.filter("not empty").select("first", "fp"), shingle, similarity, radius)
        gone = each.select("doc_id", *by).join(classes.select(*by, "first"), by).filter("doc_id <> first").select(F.col("doc_id").cast("long").alias("gone"))
        if labels is not None:
            gone = gone.unionByName(labels.filter("id <> label").select(F.col("id").alias("gone")))
        gone = stage(gone.distinct(), "gone", outer=True)
        repeated = not each.groupBy("doc_id", "g", "h").count().filter("count > 1").isEmpty()
    ids = gone.withColumnRenamed("gone", "doc_id").withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
    out = docs.join(_few(ids, ids.count()), "doc_id", "left_anti").select(*docs.columns)
    if repeated:
        out = out.dropDuplicates(["doc_id", "text"])
    return out
