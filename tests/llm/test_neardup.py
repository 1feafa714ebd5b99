from itertools import combinations

import numpy as np
import pytest

from twinfold.llm import neardup as N
from twinfold.llm.common import table


def plain_set(text, k=5):
    """Shingles by Python's own means."""
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\v\f\r":
        words = words.replace(blank, " ")
    words = [w for w in (x.strip(N.PUNCTUATION.decode()) for x in words.split(" ")) if w]
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def first_of(texts, similarity=0.8):
    """id to smallest id of its group, by comparing all pairs."""
    sets, over = {i: plain_set(t) for i, t in texts.items()}, {i: i for i in texts}

    def top(x):
        while over[x] != x:
            x = over[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        n, m = sorted((len(x), len(y)))
        if (texts[a] or "") == (texts[b] or "") or (n and n >= similarity * m and len(x & y) >= similarity * len(x | y)):
            p, q = top(a), top(b)
            over[max(p, q)] = min(p, q)
    return {x: top(x) for x in texts}


def kept(spark, texts, **more):
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r.doc_id for r in N.drop_near_duplicates(d, **more).collect()}


def test_sets_equal_plain_ones():
    texts = ["", None, "a", "One, two  three.", "(A) b c d e f! A b C d e", "- * |", "Äb c d e f " * 30, *(f"w{i} " * (i % 9) + "x, " * (i % 4) for i in range(60))]
    texts += [" ".join(f"v{i * i}" for i in range(60_000)), "z" * 400_000 + " y", "last one, of them all here"]
    sets = list(N.shingle_sets(texts, 5))
    assert [len(s) for s in sets] == [len(plain_set(t)) for t in texts]
    by = {}
    for t, s in zip(texts, sets, strict=True):
        assert by.setdefault(frozenset(plain_set(t)), s.tobytes()) == s.tobytes()
        assert (s == N.shingle_set(t, 5)).all()
    assert (N.shingle_set("A, b. C d e f", 5) == N.shingle_set("a b c D e f!", 5)).all()


def test_equals_brute_force_on_documents(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.01")
    texts = {r.doc_id: r.text for r in table(spark, d, "documents").collect()}
    first = first_of(texts)
    got = {r.doc_id for r in N.drop_near_duplicates(table(spark, d, "documents")).collect()}
    assert got == {x for x in texts if first[x] == x}


def variants(rng, n, words, edits):
    base = [f"w{x}" for x in rng.integers(0, 5000, words)]
    out = []
    for _ in range(n):
        copy = [*base]
        for at in rng.integers(0, words, int(rng.integers(0, edits + 1))):
            copy[int(at)] = f"x{int(rng.integers(0, 10**6))}"
        out.append(" ".join(copy))
    return out


def test_fingerprints_of_many_texts_are_those_of_each():
    texts = ["", "a", "a b", None, *("w%d " % i * (i % 700) + "x y" for i in range(1, 3000, 7)), "end"]
    got = []
    for _, _, h, ends in N.word_chunks(texts):
        got += N.majorities(*N.shingles(h, ends, 2)).tolist()
    for t, fp in zip(texts, got, strict=True):
        h, ends = next((h, e) for _, _, h, e in N.word_chunks([t]))
        x, a, b = N.shingles(h, ends, 2)
        x = x[a[0] : b[0]].tolist()
        want = sum(1 << i for i in range(64) if 2 * sum(v >> i & 1 for v in x) > len(x)) if x else 0
        assert fp & (1 << 64) - 1 == want


@pytest.mark.parametrize("settings", [{}, {"radius": 3}, {"rounds": 0}, {"block": 5}, {"late": 3}])
def test_links_depend_on_nothing_but_the_texts(spark, monkeypatch, settings):
    """Groups of copies with scattered changes, chains, a passage that all share, short texts; whatever fingerprints, rounds, blocks and orders find first."""
    rng = np.random.default_rng(5)
    rows = [x for n, words, edits in ((40, 120, 6), (30, 60, 3), (2, 40, 2), (2, 30, 1), (2, 300, 12), (25, 12, 1)) for x in variants(rng, n, words, edits)]
    tail = " " + " ".join(f"same{x}" for x in range(30))
    rows += [x + tail for x in variants(rng, 20, 20, 2)] + [" ".join(f"u{x}" for x in rng.integers(0, 10**6, 8)) + tail for _ in range(40)]
    rows += ["", None, "", "...", "...", "one two", "One, two!", "three"]
    texts = dict(enumerate(rows))
    if "rounds" in settings:
        monkeypatch.setattr(N.groups, "__defaults__", (N.RADIUS, 0))
    if "block" in settings:
        monkeypatch.setattr(N.all_pairs, "__defaults__", (settings["block"],))
        monkeypatch.setattr(N.groups, "__defaults__", (N.RADIUS, 0))
        monkeypatch.setattr(N, "PAIRS_HELD", 10)
    if "late" in settings:
        monkeypatch.setattr(N, "LATE", 3)
        monkeypatch.setattr(N, "COUNTED", 2000)
    first = first_of(texts)
    assert kept(spark, texts, **{k: v for k, v in settings.items() if k == "radius"}) == {x for x in texts if first[x] == x}


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(6)
    for _ in range(500):
        a = np.unique(rng.integers(0, 1 << 62, int(rng.integers(0, 300))).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.random()], rng.integers(0, 1 << 62, int(rng.integers(0, 300))).astype(np.uint64)]))
        least = N.differ_at_least(N.sketch(a), N.sketch(b))
        assert least <= len(np.setxor1d(a, b))
        assert least > 0.3 * len(np.setxor1d(a, b)) or len(np.setxor1d(a, b)) < 20 or len(np.setxor1d(a, b)) > 0.5 * min(len(a), len(b))


def test_prefixes_meet():
    rng = np.random.default_rng(3)
    late = np.sort(rng.choice(300, 40, replace=False)).astype(np.uint64)
    rank = rng.permutation(40)
    for _ in range(2000):
        a = np.unique(rng.integers(0, 300, int(rng.integers(1, 30))).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 300, 1).astype(np.uint64)]))
        for order in (N.Order(late, rank), N.Order(late[:0], rank[:0])):
            p, q = (order.prefix(x, 0.8) for x in (a, b))
            assert set(p.tolist()) <= set(a.tolist())
            assert not N.similar(a, b, 0.8) or set(p.tolist()) & set(q.tolist())


def test_odd_rows(odd_docs, no_docs):
    out = N.drop_near_duplicates(odd_docs)
    assert out.columns == odd_docs.columns
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == [1, 3, 5, 6, 7]
    assert out.filter("doc_id is null").count() == 1
    assert N.drop_near_duplicates(no_docs).count() == 0
