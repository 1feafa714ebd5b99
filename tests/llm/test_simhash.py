from itertools import combinations

import numpy as np
import xxhash

from twinfold.llm import simhash as S
from twinfold.llm.common import table
from twinfold.operators.graph import components


def plain_fp(text, k=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    sh = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def groups(fps, radius):
    label = {f: f for f in fps}
    while True:
        new = {f: min(label[g] for g in fps if (f ^ g).bit_count() <= radius) for f in fps}
        if new == label:
            return label
        label = new


def test_fingerprints():
    for t in ("", None, "A b", "one Two  three\tfour ÄÖ five", "x " * 70000):
        assert S.majority(S.shingle_hashes(t, 3)) & (1 << 64) - 1 == plain_fp(t)


def test_thresholds_are_complete():
    rng = np.random.default_rng(0)
    for n in (100, 10**6, 10**10):
        for m in (2, 3, 4):
            parts = S.group_bits(1, np.eye(64), m)
            assert sorted(b for g in parts for b in g) == list(range(64))
            _, ts = S.allocate(n, rng.random(64) * 0.2 + 0.4, parts, 3)
            assert sum(t + 1 for t in ts) == 4


def test_links_are_exact_also_in_split_buckets(spark):
    rng = np.random.default_rng(1)
    fps = {0}
    for base in (0, int(rng.integers(0, 2**63))):
        for _ in range(150):
            x = base
            for b in rng.choice(64, int(rng.integers(0, 6)), replace=False):
                x ^= 1 << int(b)
            fps.add(S.signed(x))
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = {(min(a, b), max(a, b)) for a, b in combinations(fps, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert {(r.a, r.b) for r in S.links(frame, 3, hot=30).collect()} == want
    # a forest names the same components, in one row a fingerprint and task at most
    rows = S.forest(frame, 3, hot=30).collect()
    assert all((min(r.node, r.near), max(r.node, r.near)) in want or r.near == r.root for r in rows)
    tops = lambda pairs: {r.node: r.label for r in components(spark.createDataFrame(list(pairs), "a long, b long")).collect()}
    assert tops((r.node, r.root) for r in rows) == tops(want)


def test_query_equals_brute_force(spark, sf_dir):
    docs = {r.doc_id: plain_fp(r.text) for r in table(spark, sf_dir, "documents").collect()}
    label = groups(sorted(set(docs.values())), 3)
    first = {}
    for d, f in sorted(docs.items()):
        first.setdefault(label[f], d)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in S.op7_simhash(spark, sf_dir).collect()}
    assert got == {d: (f, first[label[f]]) for d, f in docs.items()}


def test_odd_rows(odd_docs, no_docs):
    got = S.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert {r.component_id for r in got if r.fp == 0} == {3}
    assert {r.component_id for r in got if r.doc_id in (1, 2)} == {1}
    assert S.near_duplicates(no_docs).count() == 0
