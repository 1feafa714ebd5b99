import pytest

from twinfold.llm import mixing


def fill(sizes, share, cap):
    """Water-filling by repeated clamping."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = dict(zip(names, (3, 1, 2) * len(names), strict=False))
    left, out, budget = set(names), {}, share * sum(sizes.values())
    while left:
        want = {s: budget * w[s] / sum(w[x] for x in left) for s in left}
        over = [s for s in left if want[s] > cap * sizes[s]]
        if not over:
            return out | want
        for s in over:
            out[s] = cap * sizes[s]
            budget -= out[s]
            left.remove(s)
    return out


def test_targets_equal_repeated_clamping(spark):
    sizes = {"a": 1000, "b": 50, "c": 700, "d": 3, None: 400, "e": 90}
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(fill(sizes, 1.5, 2.0))


def test_mix_comes_near_targets_and_reruns_agree(spark):
    rows = [(i, "w " * (1 + i * 7 % 50), f"s{i % 3}" if i % 10 else None) for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    a, b = ({tuple(r) for r in mixing.mix(d).collect()} for _ in range(2))
    assert a == b
    assert len(a) == 3000
    by = {}
    for _, source, size, total, target, _, taken in a:
        x = by.setdefault(source, [0, total, target])
        x[0] += taken
        assert taken in (0, size, 2 * size)
    assert all(abs(t - target) <= 50 for t, _, target in by.values())


def test_odd_rows(odd_docs, no_docs):
    got = mixing.mix(odd_docs, keep=("text", "lang")).collect()
    assert len(got) == odd_docs.count()
    assert {r.taken for r in got if r.text is None or not r.text.split()} == {0}
    assert mixing.mix(no_docs).count() == 0
