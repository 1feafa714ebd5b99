"""What the operators of this subpackage share: written tables, keys and small text helpers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import new_path, scratch, stage

__all__ = ["WORD", "WORD_RE", "crc_mod", "in_sample", "n_words", "new_path", "sample_limit", "scratch", "slices", "stage", "table"]

#: Rows of a batch of texts that an Arrow function turns into Python's own at a time.
PIECE_ROWS = 256
#: A word is a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)


def n_words(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = PIECE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows at most, so that few texts are Python's own at a time; an empty batch stays one."""
    for b in batches:
        for i in range(0, max(1, b.num_rows), rows):
            yield b.slice(i, rows)


def sample_limit(rows: int, n: int) -> int:
    """Bound below which a 63-bit hash lies for about that many of n rows; of any n, however large, some are below."""
    return (1 << 63) - 1 if n <= rows else max(1, (rows << 63) // n)


def in_sample(key: Column | str, limit: Column | int, seed: int = 42) -> Column:
    """Whether the key's 63-bit hash is below limit (of sample_limit)."""
    h = F.xxhash64(key, F.lit(seed)).bitwiseAND(F.lit((1 << 63) - 1))
    return h < (F.lit(limit) if isinstance(limit, int) else limit)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n (null id: of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n
