"""Removal of repeated substrings by longest-previous-factor arrays over suffix order.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller id;
the first copy stays. Sorting all suffixes of a corpus in one array is out of reach, so
strings are first dealt so that equal ones meet:

1. Every window of ``length`` bytes takes the least hash of its GRAM-byte pieces as its key; equal windows have equal
   keys. Neighbouring windows mostly share a key and form a run. Documents are held in blocks (by hash of the id), and
   each block sends its distinct keys; a key that other documents have too comes back, with a mark if many blocks have it.
2. Blocks send the bytes of the runs with such keys, equal runs once. Runs of marked (hot) keys are parted again, by the least of a
   second hash of the same pieces, and equal ones of several blocks are made one in salted tasks first; so neither a
   piece with many contexts nor a passage in many documents fills one task. Where the keys meet, all
   windows are sorted as suffixes; longest common prefixes of neighbours, and the previous and next
   suffix with a smaller document in suffix order, give each window's longest previous factor.
3. Windows whose factor reaches the length come back as byte ranges, are united, and removed.

Hashes only bring windows together; bytes decide. Runs between tasks are packed in compressed binary cells.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table

LENGTH = 50
GRAM = 16
#: Bytes of text in a block of documents, and for each bucket of keys, about.
BLOCK_BYTES = 6 << 20
KEYS_BYTES = 4 << 20
#: Bytes of text that are hashed at a time.
CHUNK = 1 << 17
LAST = np.iinfo(np.int64).max
#: Blocks that have a key beyond which it is hot. This deals work only; any number gives the same result.
HOT_BLOCKS = 48

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def window_keys(data: bytes, length: int = LENGTH, gram: int = GRAM, second: bool = False) -> np.ndarray:
    """For each window of length bytes that starts in data, its key (or second key); data holds at least length bytes."""
    n = len(data)
    raw = data + b"\0" * 8
    x = np.ndarray((n + 1,), dtype="<u8", buffer=raw, strides=(1,)).copy()
    h = None
    last = n - gram + 1
    for k, at in enumerate([*range(0, gram - 8, 8), gram - 8]):
        y = x[at : at + last] * _M[k % 3]
        y ^= y >> np.uint64(31)
        h = y if h is None else h * _M[1] + y
    h ^= h >> np.uint64(32)
    h *= _M[3]
    h ^= h >> np.uint64(29)
    if second:
        h *= _M[0]
        h ^= h >> np.uint64(31)
    width, step = length - gram + 1, 1
    while step * 2 <= width:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    if width > step:
        h = np.minimum(h[: -(width - step)], h[width - step :])
    return h


def runs(docs: list[bytes], length: int = LENGTH, gram: int = GRAM, hot: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of windows with equal keys: key, place of the document, first window, number of windows, second key; some documents at a time.

    Where the key is in hot (sorted), the second key is equal in a run, too; elsewhere it is 0.
    """
    i = 0
    while i < len(docs):
        group, size = [], 0
        while i < len(docs) and (not group or size < CHUNK):
            if len(docs[i]) >= length:
                group.append(i)
                size += len(docs[i])
            i += 1
        if not group:
            continue
        data = b"".join(docs[g] for g in group)
        keys = window_keys(data, length, gram)
        sizes = np.array([len(docs[g]) for g in group])
        ends = np.cumsum(sizes)
        new = np.zeros(len(data) + 1, dtype=bool)
        new[1 : len(keys)] = keys[1:] != keys[:-1]
        new[0] = True
        second = None
        if hot is not None and len(hot):
            begin = np.flatnonzero(new[: len(keys)])
            at = np.minimum(np.searchsorted(hot, keys[begin]), len(hot) - 1)
            is_hot = hot[at] == keys[begin]
            if is_hot.any():
                is_hot = np.repeat(is_hot, np.diff(np.append(begin, len(keys))))
                second = np.where(is_hot, window_keys(data, length, gram, second=True), np.uint64(0))
                new[1 : len(keys)] |= second[1:] != second[:-1]
        new[ends] = new[ends - length + 1] = True
        starts = np.flatnonzero(new[: len(keys)])
        place = np.searchsorted(ends, starts, side="right")
        stop = np.minimum(np.append(starts[1:], len(keys)), ends[place] - length + 1)
        ok = stop > starts
        starts, stop, place = starts[ok], stop[ok], place[ok]
        yield keys[starts], np.array(group)[place], starts - (ends - sizes)[place], stop - starts, np.zeros(len(starts), np.uint64) if second is None else second[starts]


def previous_factors(order: np.ndarray, lcp: np.ndarray, doc: np.ndarray, enough: int) -> np.ndarray:
    """Longest previous factor, up to ``enough``, of each suffix: its longest match with a suffix of a smaller document.

    order is the suffix order, lcp[i] the common prefix of the suffixes at places i - 1 and i, doc each suffix's document. The
    nearest smaller documents before and after a place are found by following the places already found,
    with the least common prefix on the way. A way below ``enough`` is given up.
    """
    n, best = len(order), np.zeros(len(order), dtype=np.int64)
    key = doc[order]
    for forward in (False, True):
        k = key[::-1] if forward else key
        near = lcp[::-1] if forward else lcp
        # far[i]: a place before i such that all between are no smaller than k[i]; way[i]: least common prefix on the way to it
        far = np.arange(-1, n - 1)
        way = np.concatenate([[0], near[:-1] if forward else near[1:]]) if n else near
        live = np.flatnonzero(way >= enough)
        while len(live):
            j = far[live]
            live = live[k[j] >= k[live]]
            j = far[live]
            way[live], far[live] = np.minimum(way[live], way[j]), far[j]
            live = live[(way[live] >= enough) & (far[live] >= 0)]
        found = np.zeros(n, dtype=np.int64)
        ok = far >= 0
        ok[ok] = k[far[ok]] < k[ok]
        found[ok] = way[ok]
        best = np.maximum(best, found[::-1] if forward else found)
    out = np.zeros(n, dtype=np.int64)
    out[order] = best
    return out


def suffix_order(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of data that start at ``at``, by their first length bytes, and the common prefix of each with the one before.

    Eight bytes at a time, from the first: only suffixes that are still equal to a neighbour are sorted on.
    """
    raw = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), dtype=">u8", buffer=raw, strides=(1,))
    width = min(8, length)
    cut = np.uint64(64 - 8 * width)

    def column(rows: np.ndarray, off: int) -> np.ndarray:
        return eight[at[rows] + off].astype(np.uint64) >> cut

    n = len(at)
    order, lcp, new = np.arange(n), np.full(n, length, dtype=np.int64), np.zeros(n, dtype=bool)
    new[:1] = True
    lcp[:1] = 0
    for off in [*range(0, length - width + 1, 8), length - width] if length % 8 else range(0, length, 8):
        edge = np.append(new[1:], True)
        live = np.flatnonzero(~(new & edge))  # in a group of several
        if not len(live):
            break
        rows, group = order[live], np.cumsum(new)[live]
        x = column(rows, off)
        by = np.lexsort((x, group)) if off else np.argsort(x, kind="stable")
        order[live], x = rows[by], x[by]
        differ = np.flatnonzero((x[1:] != x[:-1]) & ~new[live[1:]]) + 1
        places = live[differ]
        new[places] = True
        diff = (x[differ] ^ x[differ - 1]) << cut
        same = np.zeros(len(diff), dtype=np.int64)  # equal bytes of the eight
        for k in range(1, 8):
            same += diff >> np.uint64(64 - 8 * k) == 0
        lcp[places] = off + same
    return order, lcp


def factor_lengths(contents: list[bytes], docs: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The longest previous factor up to length, by document, of all windows of the contents in order; and where each content's begin, and their number."""
    counts = np.array([len(c) - length + 1 for c in contents], dtype=np.int64)
    ends = np.concatenate([[0], np.cumsum(counts)])
    if not len(counts):
        return np.empty(0, np.int64), ends
    data = np.frombuffer(b"".join(contents), dtype=np.uint8)
    first = np.cumsum([0, *map(len, contents)])[:-1]
    at = np.repeat(first - ends[:-1], counts) + np.arange(ends[-1])
    order, lcp = suffix_order(data, at, length)
    return previous_factors(order, lcp, np.repeat(docs, counts), length), ends


def to_ranges(hit: np.ndarray, start: int, length: int) -> list[tuple[int, int]]:
    """Byte ranges that the windows marked in hit cover; the first window is at start."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [(start + int(a), start + int(b) - 1 + length) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def unite(ranges: np.ndarray) -> np.ndarray:
    """Sorted, disjoint and not touching ranges of the same bytes."""
    if not len(ranges):
        return ranges
    r = ranges[np.argsort(ranges[:, 0], kind="stable")]
    end = np.maximum.accumulate(r[:, 1])
    new = np.concatenate([[True], r[1:, 0] > end[:-1]])
    return np.stack([r[new, 0], end[np.append(np.flatnonzero(new)[1:], len(r)) - 1]], axis=1)


def block_rows(t: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Texts as bytes and ids (null: the last) of a block, in the order by id and text, and the places of these rows in the table."""
    texts = t.column("text").cast(pa.binary()).fill_null(b"").to_pylist()
    ids = t.column("doc_id").fill_null(LAST).to_numpy().astype(np.int64)
    order = np.array(sorted(range(len(texts)), key=lambda i: (ids[i], texts[i])), dtype=np.int64)
    return [texts[i] for i in order], ids[order], order


def pack(x: bytes | np.ndarray) -> bytes:
    """Compressed, behind its length."""
    raw = x if isinstance(x, bytes) else x.tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpack(x: bytes) -> bytes:
    return pa.Codec("zstd").decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True)


def _table(cols: dict, schema: pa.Schema) -> pa.Table:
    return pa.table({f.name: pa.array(cols[f.name], f.type) for f in schema}, schema=schema)


_KEYS = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("one", pa.binary()), ("more", pa.binary())])
_LISTS = pa.schema([("block", pa.int64()), ("keys", pa.binary()), ("hot", pa.binary())])
_RUNS = pa.schema([("bucket", pa.int64()), ("salt", pa.int64()), ("block", pa.int64()), ("heads", pa.binary()), ("bytes", pa.binary()), ("ranges", pa.binary())])
_RANGES = pa.schema([("block", pa.int64()), ("ranges", pa.binary())])


def send_keys(t: pa.Table, n_buckets: int, length: int, gram: int) -> pa.Table:
    """Step 1 of a block: its distinct keys by bucket, apart those that several of its documents have."""
    docs, ids, _ = block_rows(t)
    got = [(k, ids[p]) for k, p, *_ in runs(docs, length, gram)]
    out: dict[str, list] = {f.name: [] for f in _KEYS}
    if got:
        k, d = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.argsort(k, kind="stable")
        k, d = k[order], d[order]
        new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        more = np.minimum.reduceat(d, new) != np.maximum.reduceat(d, new)
        keys = k[new]
        bucket = (keys % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        keys, more, bucket = keys[order], more[order], bucket[order]
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
            out["bucket"].append(int(bucket[a]))
            out["block"].append(t.column("block")[0].as_py())
            out["one"].append(keys[a:b][~more[a:b]].tobytes())
            out["more"].append(keys[a:b][more[a:b]].tobytes())
    return _table(out, _KEYS)


def shared_keys(t: pa.Table, hot: int) -> pa.Table:
    """Step 1 of a bucket: for each block its keys that several documents have, and which of these more than hot blocks have."""
    one, more = ([np.frombuffer(x, np.uint64) for x in t.column(c).to_pylist()] for c in ("one", "more"))
    sizes = [(len(x), len(y)) for x, y in zip(one, more, strict=True)]
    keys = np.concatenate([z for x in zip(one, more, strict=True) for z in x])
    known = np.repeat([z for _ in sizes for z in (False, True)], [z for x in sizes for z in x])
    row = np.repeat(np.arange(len(sizes)), [sum(x) for x in sizes])
    order = np.argsort(keys, kind="stable")
    new = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]])) if len(keys) else np.empty(0, np.int64)
    n = np.diff(np.append(new, len(keys)))  # blocks with the key
    shared = np.empty(len(keys), dtype=bool)
    many = np.empty(len(keys), dtype=bool)
    if len(keys):
        shared[order] = np.repeat((n > 1) | np.logical_or.reduceat(known[order], new), n)
        many[order] = np.repeat(n > hot, n)
    cuts = np.searchsorted(row, np.arange(len(sizes) + 1))
    out: dict[str, list] = {"block": [], "keys": [], "hot": []}
    for block, a, b in zip(t.column("block").to_pylist(), cuts, cuts[1:], strict=False):
        at = np.flatnonzero(shared[a:b]) + a
        if len(at):
            out["block"].append(block)
            out["keys"].append(keys[at].tobytes())
            out["hot"].append(many[at].tobytes())
    return _table(out, _LISTS)


def send_runs(t: pa.Table, lists: pa.Table, n_buckets: int, n_salts: int, length: int, gram: int) -> pa.Table:
    """Step 2 of a block: the runs with shared keys, equal ones once, for its smallest document; later documents' copies are ranges at once.

    Runs of hot keys are parted by the second key, and salted by block.
    """
    out: dict[str, list] = {f.name: [] for f in _RUNS}
    if not t.num_rows or not lists.num_rows:
        return _table(out, _RUNS)
    docs, ids, _ = block_rows(t)
    block = t.column("block")[0].as_py()
    keys, hot = (np.concatenate([np.frombuffer(x, kind) for x in lists.column(c).to_pylist()]) for c, kind in (("keys", np.uint64), ("hot", bool)))
    order = np.argsort(keys)
    keys, hot = keys[order], hot[order]
    first: dict[bytes, int] = {}
    cols: list[np.ndarray] = []  # bucket, salt, document, place, start, bytes of the runs that are sent
    gone: list[np.ndarray] = []  # place, start, stop of the others
    contents: list[bytes] = []
    salt = block % n_salts
    for k, place, start, n, second in runs(docs, length, gram, keys[hot]):
        at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
        hits = np.flatnonzero(keys[at] == k)  # in the order of ids
        p, a, d = place[hits], start[hits], ids[place[hits]]
        b = a + n[hits] + length - 1
        later = np.zeros(len(hits), dtype=bool)
        for i, (x, y, z, w) in enumerate(zip(p.tolist(), a.tolist(), b.tolist(), d.tolist(), strict=True)):
            content = docs[x][y:z]
            if first.setdefault(content, w) < w:
                later[i] = True
            else:
                contents.append(content)
        gone.append(np.stack([p, a, b], axis=1)[later])
        bucket = (k[hits] % np.uint64(n_buckets) + second[hits] % np.uint64(n_buckets)) % np.uint64(n_buckets)
        cols.append(np.stack([bucket.astype(np.int64), np.where(hot[at[hits]], salt, -1), d, p, a, b - a], axis=1)[~later])
    _put(out, np.concatenate(cols) if cols else np.empty((0, 6), np.int64), contents, block)
    if sum(map(len, gone)):
        for name, x in zip(out, (block % n_buckets, -1, block, None, None, pack(np.concatenate(gone))), strict=True):
            out[name].append(x)
    return _table(out, _RUNS)


def _put(out: dict[str, list], cols: np.ndarray, contents: list[bytes], block: int) -> None:
    """Rows of a block's runs, one for each bucket and salt."""
    order = np.lexsort((cols[:, 1], cols[:, 0]))
    cols = cols[order]
    cuts = [0, *(np.flatnonzero((cols[1:, :2] != cols[:-1, :2]).any(1)) + 1).tolist(), len(cols)] if len(cols) else []
    for a, b in zip(cuts, cuts[1:], strict=False):
        data = b"".join([contents[i] for i in order[a:b].tolist()])
        for name, x in zip(out, (int(cols[a, 0]), int(cols[a, 1]), block, pack(np.ascontiguousarray(cols[a:b, 2:])), pack(data), None), strict=True):
            out[name].append(x)


def unpack_runs(t: pa.Table) -> tuple[dict[int, list[np.ndarray]], np.ndarray, list[bytes], dict[bytes, int]]:
    """Ranges found before by block; block, document, place, start and size of each run; its bytes; and the smallest document of equal bytes."""
    found: dict[int, list[np.ndarray]] = {}
    heads, contents = [np.empty((0, 5), np.int64)], []
    for block, h, data, ranges in zip(*(t.column(c).to_pylist() for c in ("block", "heads", "bytes", "ranges")), strict=True):
        if ranges is not None:
            found.setdefault(block, []).append(np.frombuffer(unpack(ranges), np.int64).reshape(-1, 3))
        if h is not None:
            h, data = np.frombuffer(unpack(h), np.int64).reshape(-1, 4), unpack(data)
            ends = np.cumsum(h[:, 3]).tolist()
            contents += [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            heads.append(np.column_stack([np.full(len(h), block), h]))
    heads = np.concatenate(heads)
    low: dict[bytes, int] = {}
    for d, c in zip(heads[:, 1].tolist(), contents, strict=True):
        if low.setdefault(c, d) > d:
            low[c] = d
    return found, heads, contents, low


def by_block(rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Rows grouped by their first column, without it."""
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    cuts = [0, *(np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1).tolist(), len(rows)] if len(rows) else []
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield int(rows[a, 0]), np.ascontiguousarray(rows[a:b, 1:])


def merge_runs(t: pa.Table) -> pa.Table:
    """Hot runs of some blocks: of equal ones the smallest document's go on, later documents' are ranges."""
    out: dict[str, list] = {f.name: [] for f in _RUNS}
    bucket = t.column("bucket")[0].as_py()
    _, heads, contents, low = unpack_runs(t)
    later = heads[:, 1] > np.fromiter(map(low.__getitem__, contents), np.int64, len(contents))
    left = np.flatnonzero(~later)
    for block, rows in by_block(np.column_stack([heads[left, 0], np.full(len(left), bucket), np.full(len(left), -1), heads[left, 1:], left])):
        _put(out, rows[:, :6], [contents[i] for i in rows[:, 6].tolist()], block)
    for block, rows in by_block(np.column_stack([heads[later][:, [0, 2, 3]], heads[later, 3] + heads[later, 4]])):
        for name, v in zip(out, (bucket, -1, block, None, None, pack(rows)), strict=True):
            out[name].append(v)
    return _table(out, _RUNS)


def find_ranges(t: pa.Table, length: int) -> pa.Table:
    """Step 2 of a bucket: byte ranges to remove, for each block."""
    found, heads, contents, low = unpack_runs(t)
    # the factor arrays are of the distinct contents, each of its smallest document: a later document's equal content goes whole
    place = {c: i for i, c in enumerate(low)}
    at = np.fromiter(map(place.__getitem__, contents), np.int64, len(contents))
    docs = np.fromiter(low.values(), np.int64, len(low))
    factors, ends = factor_lengths(list(low), docs, length)
    hit = factors >= length
    some = np.logical_or.reduceat(hit, ends[:-1]) if len(low) else np.empty(0, bool)
    later = heads[:, 1] > docs[at]
    rows = [np.column_stack([heads[later][:, [0, 2, 3]], heads[later, 3] + heads[later, 4]])]
    for i in np.flatnonzero(~later & some[at]).tolist():
        block, _, p, s, _ = heads[i].tolist()
        rows.append(np.array([(block, p, a, b) for a, b in to_ranges(hit[ends[at[i]] : ends[at[i] + 1]], s, length)], np.int64))
    for block, x in by_block(np.concatenate(rows)):
        found.setdefault(block, []).append(x)
    return _table({"block": list(found), "ranges": [pack(np.concatenate(x)) for x in found.values()]}, _RANGES)


def cut(t: pa.Table, ranges: pa.Table, with_text: bool) -> pa.Table:
    """Step 3 of a block: what is left of each document."""
    docs, _, order = block_rows(t)
    parts = [np.frombuffer(unpack(x), np.int64).reshape(-1, 3) for x in ranges.column("ranges").to_pylist()]
    every = np.concatenate(parts) if parts else np.empty((0, 3), np.int64)
    every = every[np.argsort(every[:, 0], kind="stable")]
    lo, hi = (np.searchsorted(every[:, 0], np.arange(len(docs)), side=s) for s in ("left", "right"))
    cols: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
    for i, text in enumerate(docs):
        gone = unite(every[lo[i] : hi[i], 1:])
        edges = [0, *gone.ravel().tolist(), len(text)]
        kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
        for name, x in zip(cols, (len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept), strict=True):
            cols[name].append(x)
    out = {"doc_id": t.column("doc_id").take(pa.array(order)), **{c: pa.array(cols[c], pa.string() if c == "kept_sha256" else pa.int64()) for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}}
    if with_text:
        out["kept"] = pa.array(cols["kept"], pa.binary())
    return pa.table(out)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False, hot: int = HOT_BLOCKS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes) of each row of docs (doc_id integer, text).

    Null text is empty. Rows with equal ids don't remove each other's bytes; a row without an id counts as the last, so
    it removes nothing from others. Other columns are ignored. Needs gram >= 8 and length >= gram.
    """
    spark = docs.sparkSession
    conf = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks, n_buckets = max(conf, total // BLOCK_BYTES), max(conf, total // KEYS_BYTES)
    n_salts = ceil(sqrt(n_blocks))
    # rows with equal ids meet in a block by text only where there is none: equal ids never remove each other's bytes
    block = F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.md5("text"))), F.lit(n_blocks)).alias("block")
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", block)
    blocks = each.groupBy("block")

    def ddl(s: pa.Schema) -> str:
        return ", ".join(f"{f.name} {'binary' if f.type == pa.binary() else 'long'}" for f in s)

    def keys_of(t: pa.Table) -> pa.Table:
        return send_keys(t, n_buckets, length, gram)

    def shared_of(t: pa.Table) -> pa.Table:
        return shared_keys(t, hot)

    def runs_of(t: pa.Table, lists: pa.Table) -> pa.Table:
        return send_runs(t, lists, n_buckets, n_salts, length, gram)

    def ranges_of(t: pa.Table) -> pa.Table:
        return find_ranges(t, length)

    def rest_of(t: pa.Table, ranges: pa.Table) -> pa.Table:
        return cut(t, ranges, with_text)

    keys = blocks.applyInArrow(keys_of, ddl(_KEYS))
    lists = stage(keys.groupBy("bucket").applyInArrow(shared_of, ddl(_LISTS)), "keys")
    found = stage(blocks.cogroup(lists.groupBy("block")).applyInArrow(runs_of, ddl(_RUNS)), "runs")
    merged = found.filter("salt >= 0").groupBy("bucket", "salt").applyInArrow(merge_runs, ddl(_RUNS))
    met = found.filter("salt < 0").unionByName(merged)
    ranges = stage(met.groupBy("bucket").applyInArrow(ranges_of, ddl(_RANGES)), "ranges")
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return blocks.cogroup(ranges.groupBy("block")).applyInArrow(rest_of, out)


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
