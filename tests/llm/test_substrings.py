import hashlib
import random

import numpy as np

from twinfold.llm import substrings as S
from twinfold.llm.common import table


def plain(rows, length=50):
    """Every window against every smaller id."""
    last = S.LAST
    first, out = {}, []
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            first[w] = min(first.get(w, last), last if d is None else d)
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < (last if d is None else d):
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_previous_factors_equal_brute_force():
    rng = random.Random(1)
    for _ in range(40):
        contents = ["".join(rng.choice("ab") for _ in range(rng.randint(4, 30))).encode() for _ in range(rng.randint(1, 6))]
        docs = np.array([rng.randint(0, 3) for _ in contents])
        lengths, ends = S.factor_lengths(contents, docs, 4)
        for i, c in enumerate(contents):
            for j in range(len(c) - 3):
                want = any(docs[k] < docs[i] and c[j : j + 4] in contents[k] for k in range(len(contents)))
                assert (lengths[ends[i] + j] >= 4) == want


def test_equals_brute_force_on_made_rows(spark):
    rng = random.Random(3)
    common = "".join(rng.choice("abcdé ") for _ in range(400))
    rows = [(7, None), (8, ""), (None, common), (None, common), (3, "a" * 300), (4, "a" * 301), (4, "b" * 60 + "a" * 70), (9, "short"), (2, "\0" * 120), (5, "\0" * 130)]
    for i in range(60):
        a, n = rng.randint(0, 300), rng.randint(0, 120)
        rows.append((rng.randint(0, 50), "".join(rng.choice("xyz") for _ in range(rng.randint(0, 80))) + common[a : a + n] + "".join(rng.choice("xyz") for _ in range(30))))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = plain(rows)
    for hot in (0, 1, S.HOT_BLOCKS):
        assert got(S.remove_repeats(d, hot=hot)) == want


def test_suffix_order_and_common_prefixes():
    rng = random.Random(7)
    for length in (3, 4, 8, 11, 16, 50):
        for letters in ("ab", "abcdefgh"):
            text = "".join(rng.choice(letters) for _ in range(400)).encode() * 2
            at = np.array(sorted(rng.sample(range(len(text) - length + 1), 200)))
            order, lcp = S.suffix_order(np.frombuffer(text, np.uint8), at, length)
            w = [text[i : i + length] for i in at[order]]
            assert w == sorted(w)
            assert lcp.tolist() == [0] + [next((i for i in range(length) if x[i] != y[i]), length) for x, y in zip(w, w[1:])]


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    assert got(S.op10_substrings(spark, sf_dir)) == plain(rows)


def test_odd_rows(odd_docs, no_docs):
    assert got(S.remove_repeats(odd_docs)) == plain([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert S.remove_repeats(no_docs).count() == 0
    kept = S.remove_repeats(odd_docs, with_text=True).filter("doc_id = 1").first().kept
    assert kept.decode().startswith("the quick")
