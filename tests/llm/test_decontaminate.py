import random

from twinfold.llm import decontaminate as D

ITEM = "Exactly how many apples does the small green basket of the old gardener hold on a sunny day in late August?"


def plain_distance(a, t):
    row = [0] * (len(t) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_myers_is_the_least_distance_to_a_part():
    rng = random.Random(1)
    for _ in range(300):
        a, t = ("".join(rng.choice("ab c") for _ in range(n)) for n in (rng.randint(1, 90), rng.randint(0, 120)))
        d, end = D.myers(a, t)
        assert d == plain_distance(a, t)
        assert d == plain_distance(a, t[:end])


def test_search_equals_brute_force():
    rng = random.Random(2)
    items = [(i, " ".join(rng.choice(["ab", "cde", "f", "ghij"]) for _ in range(12))) for i in range(6)]
    m = D.Matcher(items, 0.1)
    for _ in range(60):
        i, item = rng.choice(items)
        x = list(item)
        for _ in range(rng.randint(0, 5)):
            x[rng.randrange(len(x))] = rng.choice("abcxyz")
        text = "lead in " + "".join(x) + " tail"
        want = {(k, d) for k, (_, it) in enumerate(items) if (d := plain_distance(it, text)) <= int(0.1 * len(it))}
        assert {(k, d) for k, d, _, _ in m.search(text)} == want


def test_leaks_and_spans(spark, odd_docs, no_docs):
    near = ITEM.replace("green", "grean").upper()
    rows = [(1, "Before. " + ITEM + " After."), (2, "x" * 50000 + " " + near), (3, ITEM[:60]), (4, None), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(10, ITEM), (11, None), (12, " ?! ")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance, r.start, r.stop) for r in D.leaks(docs, items).collect()}
    end = len(ITEM) - 1
    assert got == {(1, 10, 0, 8, 8 + end), (2, 10, 1, 50001, 50001 + end)}
    assert sorted(r.doc_id for r in D.clean_only(docs, items).collect()) == [3, 4, 4, 5]
    assert D.clean_only(odd_docs, items).count() == odd_docs.count()
    assert D.leaks(no_docs, items).count() == 0
    assert D.leaks(docs, items.filter("item_id = 11")).count() == 0


def test_blocks_of_items(spark):
    items = spark.createDataFrame([(i, f"item number {i} of many") for i in range(10)], "item_id long, text string")
    assert [len(b) for b in D.blocks_of(items, 40)] == [2, 2, 2, 2, 2]


def test_leaks_equal_brute_force_over_all_pairs(spark):
    """The operator of the query on a small fixture: planted items with edits around the budget, one-word and wordless items, repeats, clashing columns."""
    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma", "theta"]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate((12, 9, 6, 14, 1, 3))] + [(6, None), (7, "..."), (8, "")]

    def damaged(text, edits):
        for _ in range(edits):
            i = rng.randrange(len(text))
            text = rng.choice([text[:i] + text[i + 1 :], text[:i] + "z" + text[i:], text[:i] + "q" + text[i + 1 :]])
        return text

    docs = [(100, None), (101, ""), (102, "nothing here"), (None, items[0][1])]
    for d in range(40):
        k = rng.randrange(6)
        docs.append((d, f"Before, {' '.join(rng.choice('mnop') * 3 for _ in range(6))}; {damaged(items[k][1], rng.randrange(8)).title()} after that."))
    docs += docs[-2:]
    frame = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], "doc_id long, text string, distance string, start int, item_id int").repartition(3)
    bench = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, doc_id string")
    got = sorted(((r.doc_id, r.item_id, r.distance) for r in D.leaks(frame, bench).collect()), key=str)
    want = []
    for i, t in docs:
        for k, item in items:
            norm = D.normal(item)
            if norm and (best := plain_distance(norm, D.normal(t))) <= int(D.RATE * len(norm)):
                want.append((i, k, best))
    assert got == sorted(want, key=str)
    left = D.clean_only(frame, bench)
    assert left.columns == frame.columns
    assert sorted((str(r.doc_id) for r in left.collect())) == sorted(str(i) for i, t in docs if not any(w[0] == i for w in want))
