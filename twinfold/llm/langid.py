"""Language identification by rank-order n-gram profiles.

A profile lists a language's most frequent n-grams of letters (one to three, words padded with a blank) by rank.
A document's own most frequent n-grams are compared with each profile: an n-gram adds the
difference of its two ranks, or the profile's length where the profile lacks it. The language
with the least out-of-place distance wins; ties go to the smaller code.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import crc_mod, in_sample, sample_limit, slices, table

#: Ranks in a profile; n-grams of a document that are compared.
PROFILE = 400
DOC_GRAMS = 300
#: Labelled documents of a language, about, from which its profile is learned.
SAMPLE_PER_LANG = 1500
BITS = 21  # of a code point


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point, itself if it is a letter, else a blank."""
    return np.array([i if chr(i).isalpha() else 32 for i in range(0x110000)], dtype=np.int64)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the lower-cased letters, as integers, and their counts; most frequent first, ties by integer."""
    c = _letters()[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    c = c[~((c == 32) & np.roll(c == 32, 1)) | (np.arange(len(c)) == 0)]
    if len(c) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    two = (c[:-1] << BITS) | c[1:]
    three = (c[:-2] << (2 * BITS)) | two[1:]
    v, n = np.unique(np.concatenate([c[c != 32], two, three]), return_counts=True)
    order = np.argsort(-n, kind="stable")
    return v[order], n[order]


def learn(docs: DataFrame, profile: int = PROFILE, sample: int = SAMPLE_PER_LANG) -> dict[str, np.ndarray]:
    """Language to its ranked n-grams, from docs (doc_id, text, lang) with neither text nor lang null.

    At most about ``sample`` documents of a language count, chosen by hash of the id. What is collected is
    languages times profile rows.
    """
    known = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    limit = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(sample_limit(sample, n)))])
    part = known.filter(in_sample("doc_id", limit[F.col("lang")]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[str, list] = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                found.setdefault(lang, []).append(grams(text))
            for lang, xs in found.items():
                v, at = np.unique(np.concatenate([x[0] for x in xs]), return_inverse=True)
                n = np.bincount(at, weights=np.concatenate([x[1] for x in xs]), minlength=len(v)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(v), pa.string()), pa.array(v), pa.array(n)], ["lang", "gram", "n"])

    counts = part.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # ranked in salted parts first, so that no language's whole vocabulary meets in one task
    rank = F.row_number().over(W.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(64))).orderBy(F.desc("n"), "gram"))
    first = counts.withColumn("r", rank).filter(F.col("r") <= profile)
    top = first.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("r") <= profile)
    out: dict[str, list] = {}
    for r in top.orderBy("lang", "r").collect():
        out.setdefault(r["lang"], []).append(r["gram"])
    return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


class Profiles:
    """Profiles in one sorted table: n-gram, language, rank."""

    def __init__(self, ranked: dict[str, np.ndarray]):
        self.langs = sorted(ranked)
        self.n = max([1, *map(len, ranked.values())])
        self.grams = np.unique(np.concatenate([ranked[k] for k in self.langs])) if ranked else np.empty(0, np.int64)
        self.rank = np.full((len(self.grams), len(self.langs)), -1, dtype=np.int64)
        for j, k in enumerate(self.langs):
            self.rank[np.searchsorted(self.grams, ranked[k]), j] = np.arange(len(ranked[k]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: one less the distance over the largest possible; und and 0 without letters or profiles."""
        v = grams(text)[0][:DOC_GRAMS] if text else ()
        if not len(v) or not self.langs:
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.grams, v), len(self.grams) - 1)
        rank = np.where((self.grams[at] == v)[:, None], self.rank[at], -1)
        away = np.where(rank < 0, self.n, np.minimum(np.abs(rank - np.arange(len(v))[:, None]), self.n)).sum(0)
        best = int(np.argmin(away))
        return self.langs[best], float(1 - away[best] / (self.n * len(v)))


def identify(docs: DataFrame, ranked: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score of each row of docs (doc_id, text; other columns are ignored); null or letterless text is und."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    model = Profiles(ranked)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = [model.predict(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {id_type}, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod(F.col("doc_id"), 4) == 2
    out = identify(docs, learn(docs.filter(~held)))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
