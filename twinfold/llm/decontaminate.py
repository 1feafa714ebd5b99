"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are compared as lower-case words of letters and digits, single-spaced. An item of n
characters may differ in ``floor(rate * n)`` edits. Split into one piece more than that, at least one piece must stand in
the document unchanged. All pieces are searched at once by an Aho-Corasick automaton; the
surroundings of each hit are verified by Myers' bit-parallel edit distance.

The items are a stated query set. They are held in blocks of at most BLOCK_CHARS characters, each of which passes over
all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table

RATE = 0.08
BLOCK_CHARS = 8_000_000
TOKEN = re.compile(r"\w+")


def normal(text: str | None) -> str:
    return " ".join(TOKEN.findall(text.lower())) if text else ""


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """The item in budget + 1 pieces of nearly equal length: place and text."""
    k = min(budget + 1, len(item))
    cuts = [len(item) * i // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of pattern to any part of text, and the end of the first part at that distance."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    every, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score = every, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        diag = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | ~(diag | up) & every, up & diag
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
        plus, minus = plus << 1, minus << 1
        up, down = (minus | ~(diag | down | plus)) & every, plus & (diag | down) & every
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    """Items with their pieces in one automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [(i, n, int(rate * len(n))) for i, n in items]
        at: dict[str, list[tuple[int, int]]] = {}
        for k, (_, item, budget) in enumerate(self.items):
            for place, piece in pieces(item, budget):
                at.setdefault(piece, []).append((k, place + len(piece) - 1))  # from the piece's end back to the item's start
        self.automaton = ahocorasick.Automaton()
        for piece, where in at.items():
            self.automaton.add_word(piece, where)
        self.automaton.make_automaton()

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item's place, distance, start, end) of the best match of each item within its budget in a normal text."""
        starts: dict[int, set[int]] = {}
        for end, where in self.automaton.iter(text):
            for k, shift in where:
                starts.setdefault(k, set()).add(end - shift)
        out = []
        for k, found in starts.items():
            got = self.verify(text, k, sorted(found))
            if got:
                out.append((k, *got))
        return out

    def verify(self, text: str, k: int, starts: list[int]) -> tuple[int, int, int] | None:
        _, item, budget = self.items[k]
        spans: list[list[int]] = []
        for s in starts:
            a, b = max(0, s - budget), min(len(text), s + len(item) + budget)
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(b, spans[-1][1])
            else:
                spans.append([a, b])
        best = None
        for a, b in spans:
            at = text.find(item, a, b)
            if at >= 0:
                return 0, at, at + len(item)
            d, end = myers(item, text[a:b])
            if d <= budget and (best is None or d < best[0]):
                back, length = myers(item[::-1], text[a : a + end][::-1])
                best = (d, a + end - length, a + end)
        return best


def original_span(text: str, start: int, end: int) -> tuple[int, int]:
    """Where the characters start to end of the normal text stand in the text: from the first to the last word they touch.

    Lower-casing may change a text's length; then the span is that of the lower-cased text.
    """
    at, first, last = 0, None, None
    for m in TOKEN.finditer(text.lower()):
        stop = at + m.end() - m.start()
        if first is None and stop > start:
            first = m.start()
        if at < end:
            last = m.end()
        else:
            break
        at = stop + 1
    return first or 0, last or 0


def blocks_of(items: DataFrame, size: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """Normal items with a word in them, in blocks of about that many characters at most."""
    block, n = [], 0
    for r in items.select("item_id", "text").toLocalIterator():
        if item := normal(r["text"]):
            block.append((r["item_id"], item))
            n += len(item)
            if n >= size:
                yield block
                block, n = [], 0
    if block:
        yield block


def leaks(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, item_id, distance, start, stop (in the document's characters) of each item within its edit budget of a part of a document.

    docs (doc_id, text) and items (item_id, text) may have other columns, which are ignored. Null and
    wordless texts match nothing, a null id stays null. Repeated rows of either side repeat the result. An item too short for an edit (up to
    12 characters at RATE) matches where it stands unchanged, also inside a longer word. Very long texts are searched
    whole; of several parts at the least distance the first counts.
    """
    id_type, item_type = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, item_id {item_type}, distance int, start long, stop long"
    out = docs.sparkSession.createDataFrame([], schema)
    for n, block in enumerate(blocks_of(items)):

        def scan(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, rate)
            for b in slices(batches):
                rows, ids = [], []
                for i, text in enumerate(b.column("text").to_pylist()):
                    for k, d, s, e in matcher.search(normal(text)):
                        rows.append((block[k][0], d, *original_span(text, s, e)))
                        ids.append(i)
                cols = list(zip(*rows, strict=True)) or [()] * 4
                kinds = [pa.int64() if item_type == "bigint" else None, pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(ids, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "item_id", "distance", "start", "stop"])

        found = docs.select("doc_id", "text").mapInArrow(scan, schema)
        out = found if n == 0 else out.unionByName(found)
    return out


def clean_only(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of docs, all columns, that hold none of the items within its edit budget."""
    for block in blocks_of(items):

        def keep(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, rate)
            for b in slices(batches):
                yield b.filter(pa.array([not matcher.search(normal(t)) for t in b.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "distance", "start", "stop")
