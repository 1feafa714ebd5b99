"""Quality rules as a short-circuit cascade, ordered by rejections per cost.

The base statistics are returned for every document, so they are computed first and cost no rule anything. Each rule then
rejects a document or passes it on. On a bounded sample each rule's further cost (what it computes beyond the base
statistics) is timed and its rejections are counted, in the tasks that hold the sample; then the rule with the most
rejections per second among the sample's remaining documents comes next, and so on. The order decides what a document
costs, never its verdict, so reruns agree although timings differ.
"""

from __future__ import annotations

import copy
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_sample, sample_limit, slices, table
from .textstats import TextStats

#: Documents, about, on which costs and rejections are estimated.
SAMPLE_ROWS = 500


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[TextStats], bool]


#: Limits of the base rules and of the cascade.
BASE_FAILS = Rule("base", lambda t: t.n_words < 20 or 100 * t.n_repeat_words > 30 * t.n_words)
RULES = (
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("short_words", lambda t: t.word_chars < 2 * t.n_words),
    Rule("long_words", lambda t: t.word_chars > 20 * t.n_words),
    Rule("duplicate_lines", lambda t: t.n_dup_lines > 2 and 10 * t.n_dup_lines > 3 * len(t.lines)),
    Rule("shouting", lambda t: t.n_upper > t.n_lower),
    Rule("exclamation", lambda t: 2 * t.n_exclaim > t.n_words),
    Rule("digits", lambda t: 2 * t.n_digits > t.word_chars),
    Rule("one_word", lambda t: 10 * t.top_word > 3 * t.n_words),
    Rule("bullets", lambda t: len(t.lines) > 2 and 10 * t.n_bullets > 9 * len(t.lines)),
    Rule("ellipses", lambda t: len(t.lines) > 2 and 10 * t.n_ellipses > 3 * len(t.lines)),
)
BASE_STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(text: str | None, rules: tuple[Rule, ...]) -> tuple[list[float], list[bool]]:
    """Seconds that each rule takes on the text beyond the base statistics, and whether it rejects."""
    base = TextStats(text)
    for x in BASE_STATISTICS:
        getattr(base, x)
    cost, hit = [], []
    for r in rules:
        t = copy.copy(base)  # with the statistics that it has, and none that another rule needed
        start = time.perf_counter()
        hit.append(r.rejects(t))
        cost.append(time.perf_counter() - start)
    return cost, hit


def order_rules(measured: list[tuple[list[float], list[bool]]], rules: tuple[Rule, ...]) -> tuple[Rule, ...]:
    """Rules by rejections per second, each on what the earlier ones pass; rules that reject none of these come by cost, ties keep the given order."""
    left, order, rest = list(range(len(measured))), [], list(range(len(rules)))
    while rest:
        cost = {r: max(sum(measured[i][0][r] for i in left), 1e-9) for r in rest}
        best = max(rest, key=lambda r: (sum(measured[i][1][r] for i in left) / cost[r], -cost[r], -r))
        left = [i for i in left if not measured[i][1][best]]
        order.append(best)
        rest.remove(best)
    return tuple(rules[r] for r in order)


def sample_measures(docs: DataFrame, rules: tuple[Rule, ...], rows: int = SAMPLE_ROWS) -> list[tuple[list[float], list[bool]]]:
    """measure of about that many documents, chosen by hash of the id and text; the driver gets numbers, no texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = [measure(t, rules) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.list_(pa.float64())), pa.array([g[1] for g in got], pa.list_(pa.bool_()))], ["cost", "hit"])

    key = F.struct("doc_id", F.md5("text").alias("text"))
    some = docs.select("doc_id", "text").filter(in_sample(key, sample_limit(rows, docs.count())))
    return [(list(r["cost"]), list(r["hit"])) for r in some.select("text").mapInArrow(run, "cost array<double>, hit array<boolean>").collect()]


def passes(stats: TextStats, rules: tuple[Rule, ...]) -> str | None:
    """The first rule that rejects, or None."""
    for r in rules:
        if r.rejects(stats):
            return r.name
    return None


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: Rule | None = BASE_FAILS) -> DataFrame:
    """doc_id, base statistics, base_failed and kept, for each row of docs (doc_id, text; other columns are ignored).

    Null and empty texts have no words and fail the base rule. Repeated rows are judged alike; an empty table gives no
    row. Very long texts are judged whole. A null id stays null.
    """
    ordered = order_rules(sample_measures(docs, rules), rules)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for text in b.column("text").to_pylist():
                t = TextStats(text)
                failed = base is not None and base.rejects(t)
                rows.append((t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, not failed and passes(t, ordered) is None))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            arrays = [pa.array(c, pa.int64() if i < 5 else pa.bool_()) for i, c in enumerate(cols)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *arrays], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])

    return docs.select("doc_id", "text").mapInArrow(judge, schema)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, array_to_string(ws[i:i+7], ' ') AS gram
      FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, count(DISTINCT p)::BIGINT AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM r) GROUP BY rid),
s AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
        length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_upper, length(regexp_replace(t, '[^a-z]+', '', 'g')) AS n_lower,
        coalesce(list_max(map_values(list_aggregate(ws, 'histogram'))), 0) AS top_word, len(list_filter(ls, lambda x: regexp_matches(x, '^[ \t]*[-*•]'))) AS n_bullets,
        len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipses,
        length(regexp_replace(t, '[^!]+', '', 'g')) AS n_exclaim, length(regexp_replace(t, '[^0-9]+', '', 'g')) AS n_digits
      FROM w LEFT JOIN c ON w.rid = c.rid),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR (n_dup_lines > 2 AND 10 * n_dup_lines > 3 * n_lines) OR n_upper > n_lower OR 2 * n_exclaim > n_words OR 2 * n_digits > word_chars
            OR 10 * top_word > 3 * n_words OR (n_lines > 2 AND 10 * n_bullets > 9 * n_lines) OR (n_lines > 2 AND 10 * n_ellipses > 3 * n_lines)) AS kept
FROM b
"""
