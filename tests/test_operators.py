import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from twinfold.functions import similarity as S
from twinfold.functions.tables import PRIME
from twinfold.operators import blocking as B
from twinfold.operators import brand as R
from twinfold.operators import matching as M
from twinfold.operators import tiles as L
from twinfold.operators.graph import components, stars
from twinfold.plans import experiment as X
from twinfold.sources import offers as O
from twinfold.staging import stage

FEATURES = "array<struct<key:string,value:string>>"


def offers(spark, rows):
    """(cluster, idx, brand value) rows as offers."""
    d = spark.createDataFrame(rows, "cluster_id string, idx int, v string")
    f = F.when(F.col("v").isNull(), F.array().cast(FEATURES)).otherwise(F.array(F.struct(F.lit("Brand").alias("key"), F.col("v").alias("value"))))
    return d.select("cluster_id", "idx", O.offer_id("cluster_id", "idx"), F.lit("s").alias("shop"), F.col("cluster_id").alias("model_id"), F.concat(F.lit("a sony set "), "cluster_id").alias("title"), f.alias("features"))


def test_majority_ties_go_to_the_smaller_and_titles_fill_the_rest(spark):
    d = offers(spark, [("c", 0, "lg"), ("c", 1, "sony"), ("c", 2, None), ("d", 0, None), ("e", 0, "sony")])
    got = {r.offer_id: r.brand for r in R.annotate(d).collect()}
    assert got == {"c#0": "lg", "c#1": "lg", "c#2": "lg", "d#0": "sony", "e#0": "sony"}
    assert {r.offer_id: r.brand for r in R.annotate(d, propagate=False).collect()}["c#2"] == "unknown"


def test_minhash(spark):
    d = spark.createDataFrame([([0, 1, 2],), ([],)], "ids array<bigint>")
    assert [r.x for r in d.select(B.minhash(F.col("ids"), [5], [3], 7).alias("x")).collect()] == [[1], [7]]
    assert B.hash_family(2, 123)[0][0] < PRIME


def test_bands(spark):
    s = spark.createDataFrame([("x", "a", [1, 2, 3, 4]), ("x", "b", [1, 2, 9, 9]), ("y", "c", [1, 2, 3, 4])], "brand string, offer_id string, sig array<bigint>")
    assert [tuple(r) for r in B.lsh_pairs(s, 2, 2).collect()] == [("x", "a", "b")]
    assert B.lsh_pairs(s, 1, 4).count() == 0
    assert {r.offer_id: len(r.partners) for r in B.adjacency(B.lsh_pairs(s, 2, 2), s).collect()} == {"a": 1, "b": 1, "c": 0}
    with pytest.raises(ValueError, match="bands"):
        B.bands(s, 3, 2, 4)


def test_df_filter_never_empties_an_offer(spark):
    rows = spark.createDataFrame([("x", "a", 1, "p"), ("x", "b", 2, "p"), ("x", "b", 2, "q"), ("x", "c", 3, "q"), ("x", "d", 4, "r")], "brand string, offer_id string, ord int, shingle string")
    all_ = rows.select("brand", "offer_id").distinct()
    kept = {(r.offer_id, r.shingle) for r in B.filter_by_df(rows, all_).collect()}
    assert kept == {("a", "p"), ("b", "p"), ("b", "q"), ("c", "q"), ("d", "r")}


def test_factors_and_metrics(spark):
    assert B.factor_pairs(12) == [(1, 12), (2, 6), (3, 4), (4, 3), (6, 2), (12, 1)]
    one = spark.range(1).select(*[c.alias(k) for k, c in B.pair_quality(F.lit(2), F.lit(5), F.lit(4), F.lit(10)).items()]).first()
    assert (one.pc, one.pq, one.fc, round(one.f1_star, 4)) == (0.5, 0.4, 0.5, 0.4444)


def brute_linkage(n, d, eps):
    parts = [{i} for i in range(n)]
    while True:
        best = min(((max(d.get((min(i, j), max(i, j)), 1.0) for i in a for j in b), min(a), min(b), a, b) for k, a in enumerate(parts) for b in parts[k + 1 :]), key=lambda x: (x[0], *sorted(x[1:3])), default=None)
        if best is None or best[0] >= eps:
            return sorted(sorted(p) for p in parts)
        parts = [p for p in parts if p not in (best[3], best[4])] + [best[3] | best[4]]


def test_complete_linkage_by_component_is_linkage_of_the_whole(spark):
    edges = spark.createDataFrame([("x", "a", "b", 0.1), ("x", "b", "c", 0.2)], "brand string, oid1 string, oid2 string, d double")
    assert {r.offer_id: r.cluster_id for r in M.clusters(edges, 0.3).collect()} == {"a": "a", "b": "a", "c": "c"}
    rng = np.random.default_rng(3)
    for _ in range(25):
        n = int(rng.integers(2, 9))
        d = {(i, j): float(round(rng.random(), 1)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.7}
        label = M.link([str(i) for i in range(n)], [(i, j, x) for (i, j), x in d.items()], 0.5)
        got = sorted(sorted(i for i in range(n) if label[i] == x) for x in set(label))
        assert got == brute_linkage(n, d, 0.5)


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 60), (60, 50), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in components(e).collect()}
    assert got == {**{i: 0 for i in range(21)}, 50: 50, 60: 50}


def test_pair_metrics_count_truth_across_brands(spark):
    o = spark.createDataFrame([("a", "m"), ("b", "m"), ("c", "m"), ("d", "n")], "offer_id string, model_id string")
    p = spark.createDataFrame([("b", "a"), ("a", "b"), ("a", "d"), ("a", "z")], "oid1 string, oid2 string")
    r = M.pair_metrics(p, o).first()
    assert (r.tp, r.fp, r.fn, r.n_true_pairs, r.n_pred_pairs) == (1, 1, 2, 3, 2)


def test_json_keeps_order_and_last_of_equal_keys(spark, tmp_path):
    one = {"title": "T", "shop": "s", "modelID": "m", "featuresMap": {"b": "1", "a": "2"}, "extra": 1}
    (tmp_path / "o.json").write_text('{"z": [' + json.dumps(one) + '], "a": [' + json.dumps(one | {"title": None}) + "," + json.dumps(one) + '], "z": [' + json.dumps(one | {"title": "last"}) + "]}")
    got = O.from_json(spark, str(tmp_path / "o.json")).orderBy("cluster_pos", "idx").collect()
    assert [(r.offer_id, r.title) for r in got] == [("z#0", "last"), ("a#0", None), ("a#1", "T")]
    assert [f.key for f in got[0].features] == ["b", "a"]
    assert O.first_clusters(O.from_json(spark, str(tmp_path / "o.json")), 1).count() == 1


def test_bootstrap_splits_clusters(spark):
    d = spark.createDataFrame([(str(i), i % 2 == 0) for i in range(40)], "cluster_id string, is_single boolean")
    a, b = ({(r.cluster_id, r.in_bag) for r in X.bootstrap(d, 5).collect()} for _ in range(2))
    assert a == b
    assert len(a) == 40
    assert 10 < sum(x for _, x in a) < 39


def test_search_and_band_errors(spark):
    p, m = X.tune_score(lambda p: {"f1": p.gamma}, trials=5, seed=1)
    assert m["f1"] == p.gamma
    assert all(lo <= getattr(p, k) <= hi for k, (lo, hi) in X.RANGES.items())


def test_components_of_paths_stars_and_random_links(spark):
    import random

    from twinfold.operators.graph import components

    def brute(edges):
        over = {}

        def top(x):
            while over.setdefault(x, x) != x:
                x = over[x]
            return x

        for a, b in edges:
            if a != b:
                a, b = sorted((top(a), top(b)))
                over[b] = a
        return {x: top(x) for x in over}

    rng = random.Random(1)
    path = list(range(300))
    rng.shuffle(path)
    for edges in ([*zip(path, path[1:], strict=False)], [(rng.randrange(2000), rng.randrange(2000)) for _ in range(900)], [(5, i) for i in range(300)] + [(i, i + 1000) for i in range(300)], [(1, 1), (None, 2)]):
        got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == brute([e for e in edges if None not in e])


def test_partners_are_the_digest_of_all_pairs(spark):
    d = spark.createDataFrame([("x", f"{i * 7 % 11}", i) for i in range(11)] + [("y", "b", 1), ("y", "a", 2), ("z", "c", 1)], "brand string, offer_id string, ord int")
    plain = lambda pairs: {tuple(r) for r in pairs.groupBy("brand", "oid1").agg(F.count("*"), F.min("oid2"), F.max("oid2")).collect()}
    for least in (0, 2, 3, 99):
        assert {tuple(r) for r in B.every_partner(d, least).collect()} == plain(B.every_pair(d, least))


def test_sets_are_filtered_as_rows(spark):
    rng = np.random.default_rng(8)
    sets = [("xy"[i % 2], f"o{i}", [str(s) for s in set(rng.integers(0, 12, int(rng.integers(0, 5))).tolist())]) for i in range(40)] + [("y", "alone", ["only"])]
    d = spark.createDataFrame(sets, "brand string, offer_id string, shingles array<string>")
    want = {tuple(r) for r in B.filter_by_df(B.exploded(d), d, 3, 0.3).collect()}
    for most in (0, 1000):
        got = B.filter_sets(d, 3, 0.3, most)
        assert got.count() == 41
        assert {tuple(r) for r in B.exploded(got).collect()} == want


def test_order_by_clusters_is_the_order_of_offers(spark):
    rows = [(f"c{i % 13}", i // 13, ("lg", "sony", None)[i % 13 % 3]) for i in range(60)] + [("s1", 0, "lg"), ("a1", 0, "sony")]
    d = offers(spark, rows)
    got = R.prepare(d).collect()
    for brand in {r.brand for r in got}:
        own = sorted((r for r in got if r.brand == brand), key=lambda r: (r.is_single, r.cluster_id, r.idx))
        assert [r.ord for r in own] == list(range(1, len(own) + 1))
    assert len(got) == 62
    assert {r.offer_id: r.ord for r in R.place(d.select("cluster_id", "idx", "offer_id"), R.cluster_places(d)).collect()} == {r.offer_id: r.ord for r in got}
    assert {r.offer_id: r.ord for r in R.with_order(R.mark_single(R.annotate(d))).collect()} == {r.offer_id: r.ord for r in got}
    assert {tuple(r) for r in R.cluster_sizes(d).collect()} == {(r.cluster_id, r.is_single) for r in got}


def made_signatures(spark, n=60):
    """Signatures of four places over few values, many of them equal."""
    rng = np.random.default_rng(4)
    return spark.createDataFrame([("xy"[i % 2], f"o{i}", [int(v) for v in rng.integers(0, 5, 4)]) for i in range(n)] + [("x", f"e{i}", [9, 9, 9, 9]) for i in range(5)] + [("z", "alone", [1, 1, 1, 1])], "brand string, offer_id string, sig array<bigint>")


def test_degrees_and_components_by_classes_are_those_of_pairs(spark, monkeypatch):
    sigs = made_signatures(spark)
    pairs = B.lsh_pairs(sigs, 2, 2)
    degree = {r.offer_id: len(r.partners) for r in B.adjacency(pairs, sigs).collect()}
    label = {r.node: r.label for r in components(pairs.select(F.col("oid1").alias("a"), F.col("oid2").alias("b"))).collect()}

    def no(*_, **__):
        raise AssertionError("pairs of offers are made")

    monkeypatch.setattr(B, "lsh_pairs", no)
    assert {r.offer_id: r.degree for r in B.degrees(sigs, 2, 2).collect()} == degree
    assert {r.node: r.label for r in B.lsh_components(sigs, 2, 2).collect()} == label
    assert 0 in degree.values()
    assert "alone" not in label


def test_pair_counts_are_those_of_pairs(spark, monkeypatch):
    sigs = made_signatures(spark)
    keys = stage(sigs.select("offer_id", (F.ascii(F.substring("offer_id", -1, 1)) % 3).cast("long").alias("key")), "testkeys")
    plain = B.lsh_pairs(sigs, 2, 2).join(keys.toDF("oid1", "a"), "oid1").join(keys.toDF("oid2", "b"), "oid2").groupBy("a", "b").count()
    want = {tuple(r) for r in plain.collect()}

    def no(*_, **__):
        raise AssertionError("pairs of offers are made")

    monkeypatch.setattr(B, "lsh_pairs", no)
    assert {tuple(r) for r in B.pair_counts(sigs, keys, 2, 2).collect()} == want


def test_groups_stand_for_all_pairs(spark, monkeypatch):
    sigs = made_signatures(spark)
    last = F.ascii(F.substring("offer_id", -1, 1))
    short = stage(sigs.select("offer_id", F.struct((last % 2).cast("string").alias("shop"), F.when(last % 5 == 0, F.array(F.lit("m1"))).otherwise(F.array().cast("array<string>")).alias("strong"), F.lit(None).cast("string").alias("reso"), F.when(last % 3 > 0, (last % 3).cast("double")).alias("size")).alias("p")), "testshort")
    test = lambda d: d.select("brand", "oid1", "oid2", S.blocked(F.col("p1"), F.col("p2")))
    want = sorted(tuple(r) for r in test(B.lsh_pairs(sigs, 2, 2).join(short.toDF("oid1", "p1"), "oid1").join(short.toDF("oid2", "p2"), "oid2")).collect())

    def no(*_, **__):
        raise AssertionError("pairs are tested one by one")

    monkeypatch.setattr(B, "lsh_pairs", no)
    for rows in (1, 1000):
        monkeypatch.setattr(M, "GROUP_ROWS", rows)
        met, lists = M.group_pairs(short, sigs, 2, 2)
        assert sorted((r.brand, r.oid1, r.oid2, r.blocked) for r in M.expand(met, lists, "brand", "blocked").collect()) == want


def test_feature_pairs_are_matched_as_by_match_keys(spark, monkeypatch):
    lists = [[("Brand", "lg"), ("Size", "42 inch")], [("Brand Name", "lg inc"), ("Size Class", "42inch"), ("Weight", "10.5 lb")], [("Weight", "12.0 lb"), ("Brand", "")], []]
    f = stage(spark.createDataFrame(list(enumerate(lists)), f"f long, features {FEATURES}"), "testlists")
    pairs = f.select(F.col("f").alias("f1")).crossJoin(f.select(F.col("f").alias("f2")))
    gram = lambda c: F.transform(c, lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value"), S.qgrams(x["key"]).alias("kg"), S.qgrams(x["value"]).alias("vg")))
    both = pairs.join(f.toDF("f1", "a"), "f1").join(f.toDF("f2", "b"), "f2").withColumn("x", S.match_keys(gram(F.col("a")), gram(F.col("b")), F.lit(0.3)))
    want = {(r.f1, r.f2): (r.x.sim, r.x.w, r.x.m, r.x.alone, [y.value for y in r.x.rest]) for r in both.collect()}
    for most in (0, 500):
        monkeypatch.setattr(M, "MAX_KEY_LISTS", most)
        assert {(r.f1, r.f2): (r.sim, r.w, r.m, r.alone, r.rest) for r in M.feature_pairs(pairs, f, 0.3).collect()} == want
    assert any(0 < x[0] < x[1] for x in want.values())


def test_linkage_by_items_and_matrix_is_brute_force(monkeypatch):
    rng = np.random.default_rng(11)
    for most in (0, 100):
        monkeypatch.setattr(M, "MAX_MATRIX", most)
        for _ in range(40):
            n = int(rng.integers(2, 10))
            item = rng.integers(0, 5, n)  # of each offer
            way = {(a, b): float(round(rng.random(), 1)) for a in range(5) for b in range(5) if rng.random() < 0.8}
            d = {(i, j): way[item[i], item[j]] for i in range(n) for j in range(i + 1, n) if way.get((item[i], item[j]), 1) < 0.5}
            used = sorted(set(item.tolist()))
            place = np.array([i for x in used for i in range(n) if item[i] == x])
            sizes = np.array([(item == x).sum() for x in used])
            rows = [(used.index(a), used.index(b), x) for (a, b), x in way.items() if x < 0.5 and a in used and b in used and (sizes[used.index(a)] > 1 or sizes[used.index(b)] > 1 or a != b)]
            rows = [(a, b, x) for a, b, x in rows if any(i < j for i in range(n) if item[i] == used[a] for j in range(n) if item[j] == used[b])]
            a, b, x = (np.array([r[k] for r in rows], t) for k, t in enumerate(("int64", "int64", "float64")))
            label = M.link_items(n, place, sizes, a, b, x, [str(i) for i in range(n)], 0.5)
            assert sorted(sorted(i for i in range(n) if label[i] == y) for y in set(label)) == brute_linkage(n, d, 0.5)


def test_stars_have_the_components_of_links(spark):
    rng = np.random.default_rng(5)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(-40, 200, (300, 2))], "a long, b long").repartition(3)
    assert {tuple(r) for r in components(stars(edges)).collect()} == {tuple(r) for r in components(edges).collect()}


def test_classes_meet_once_without_a_distinct(spark, monkeypatch):
    classes = B.signature_classes(made_signatures(spark))
    for b, r in ((2, 2), (4, 1), (1, 4)):
        rows = B.bands(classes.select("brand", "sig", F.col("class").alias("offer_id")), b, r)
        want = sorted(tuple(x) for x in B.band_pairs(rows).collect())
        with monkeypatch.context() as m:
            m.setattr(B, "band_pairs", None)
            assert sorted(tuple(x) for x in B.class_pairs(classes, b, r).collect()) == want


def test_candidates_by_cluster_rows_are_those_of_blocks(spark):
    rng = np.random.default_rng(7)
    titles = [None, "", "LG 42-inch MX1B2", 'LG 42" MX1B2 120Hz', "sony 55hz 10p", "Sony 9x a1 b2 c3", "plain"]
    values = [None, "", "42 Inches", "10.5 lbs.", "1920 x 1080"]
    one = lambda c: (f"c{c}", titles[rng.integers(0, 7)], None if rng.random() < 0.1 else [("Brand", ("lg", "Sony Inc.", "")[rng.integers(0, 3)] if c % 5 else ""), ("Size", values[rng.integers(0, 5)]), ("Weight", values[rng.integers(0, 5)])])
    rows = [(c, k, t, f) for n in range(12) for k, (c, t, f) in enumerate(one(n) for _ in range(int(rng.integers(1, 25))))]
    d = stage(spark.createDataFrame(rows, f"cluster_id string, idx int, title string, features {FEATURES}").select("*", O.offer_id("cluster_id", "idx")), "testoffers")
    blocks = stage(R.with_order(R.prepare(d).withColumn("brand", F.concat_ws("/", "brand", "cluster_id"))), "testblocks")
    pairs = B.candidates(blocks, stage(B.signatures(blocks, 8, 3, 9), "testsigs"), 4, 2, 9)
    want = {tuple(r) for r in pairs.groupBy("brand", "oid1").agg(F.count("*"), F.min("oid2"), F.max("oid2")).collect()}
    found = R.fill_tops(d, stage(B.cluster_candidates(R.cluster_rows(d), 8, 3, 4, 2, 9), "testfound"))
    got = [(f"{r.brand}/{r.cluster_id}", f"{r.cluster_id}#{x['at']}", x["n"], *[f"{r.cluster_id}#{x[c]}" for c in ("low", "high")]) for r in found.collect() for x in r.rows]
    assert len(got) == len(want)
    assert set(got) == want
    sizes = {r.cluster_id: len(r.idx) for r in R.cluster_rows(d).collect()}
    assert min(sizes.values()) < 9 <= max(sizes.values())


def test_keys_are_counted_by_tiles_as_by_pairs(spark, monkeypatch):
    rng = np.random.default_rng(12)
    ids = [f"{c}#{k}" for c in range(40) for k in range(int(rng.integers(1, 6)))]
    rows = [(x, x.split("#")[0], "xyz"[int(x.split("#")[0]) % 3] if i > 2 else "few", i, int(rng.integers(0, 9)), [str(int(v)) for v in rng.integers(0, 6, 2)]) for i, x in enumerate(ids)]
    o = stage(spark.createDataFrame(rows, "offer_id string, cluster_id string, brand string, ord int, key long, shingles array<string>").withColumn("shingles", F.sort_array(F.array_distinct("shingles"))), "testoffers")
    sets = B.split_blocks(o)[0]
    sigs = stage(B.set_signatures(sets, 4, 5), "testsigs")
    of = o.select("offer_id", "key")
    plain = B.candidates(o, sigs, 2, 2).join(of.toDF("oid1", "a"), "oid1").join(of.toDF("oid2", "b"), "oid2").groupBy("a", "b").count()
    want = {tuple(r) for r in plain.collect()}

    def no(*_, **__):
        raise AssertionError("pairs of classes are made")

    for where, name in ((B, "lsh_pairs"), (B, "class_pairs"), (B, "block_pairs")):
        monkeypatch.setattr(where, name, no)
    classes = B.numbered_classes(sets, 4, 5)
    keys = o.select("key", F.array(F.concat(F.lit("w"), "key")).alias("x")).distinct()
    for tile, chunk, piece, long in ((1, 1000, 1000, 1000), (1000, 3, 5, 0), (7, 1000, 1000, 2)):
        for name, value in (("TILE", tile), ("CHUNK", chunk), ("PIECE", piece), ("LONG", long)):
            monkeypatch.setattr(L, name, value)
        assert {tuple(r) for r in L.key_counts(o, *classes, keys.select("key", F.lit(0).alias("x")), 2, 2).collect()} == want
        got = L.key_counts(o, *classes, keys, 2, 2, L.rate_avg_lev, "sim double").collect()
        assert {tuple(r)[:3] for r in got} == want
        assert all(r.sim == (1.0 if r.a == r.b else 0.5) for r in got)


def test_matrices_of_words_are_the_columns(spark):
    words = ["", "a", "mx12b3", "mx12b4", "55inch", "120hz", "ünder", "x" * 9, "55inches", "b9"]
    rng = np.random.default_rng(3)
    lists = [[words[k] for k in rng.integers(0, 10, int(rng.integers(0, 5)))] for _ in range(14)] + [["a", "a", "b9"]]
    d = spark.createDataFrame([(i, x, " ".join(x)) for i, x in enumerate(lists)], "i int, x array<string>, t string")
    both = d.crossJoin(d.toDF("j", "y", "u"))
    cos = F.round(S.counted_cosine(S.counted_terms(F.col("t")), S.counted_terms(F.col("u"))), 6)
    want = {(r.i, r.j): (r.lev, r.cos) for r in both.select("i", "j", F.round(S.avg_lev(F.col("x"), F.col("y")), 6).alias("lev"), cos.alias("cos")).collect()}
    x = pa.array(lists, pa.list_(pa.string()))
    terms = pa.array([{"words": r.c["words"], "norm": r.c["norm"]} for r in d.orderBy("i").select(S.counted_terms(F.col("t")).alias("c")).collect()])
    lev, cosine = L.rounded(L.rate_avg_lev(x, x)[0]), L.rounded(L.rate_cosine(terms, terms)[0])
    assert {(i, j): (lev[i, j], cosine[i, j]) for i in range(15) for j in range(15)} == want
    ties = [0.0078125, 0.1234565, 0.5, 0.0, 1.0, 1 / 3, 2.5e-6, 0.0000005]
    assert L.rounded(np.array(ties)).tolist() == [r.x for r in spark.createDataFrame([(i, t) for i, t in enumerate(ties)], "i int, t double").select("i", F.round("t", 6).alias("x")).orderBy("i").collect()]


def test_offers_prepared_by_cluster_are_those_prepared_one_by_one(spark):
    rows = [("c1", 0, "LG 42-inch MX1B2", [("Brand", "LG"), ("Size", '42"')]), ("c1", 1, None, None), ("c1", 2, "", [("Brand Name", " "), ("BRAND", "Sony Inc."), ("Size", None)]), ("c2", 0, "Sony 50hz", [("Size", "1.5 lbs.")]), ("c3", 0, "x", [("brand", "LG")]), ("c3", 1, "x", [("brand", "lg inc")])]
    d = stage(spark.createDataFrame([(c, i, f"{c}#{i}", "s", "m", t, f) for c, i, t, f in rows], f"cluster_id string, idx int, offer_id string, shop string, model_id string, title string, features {FEATURES}"), "testoffers")
    want = R.prepare(d).withColumn("shingles", F.sort_array(B.shingles(F.col("title"), F.col("features"))))
    assert {repr(r) for r in R.prepare_by_cluster(d).select(*want.columns).collect()} == {repr(r) for r in want.collect()}


def test_matrices_of_features_are_match_keys(spark):
    rng = np.random.default_rng(9)
    keys, values = ["Brand", "Brand Name", "Screen Size", "Screen Size Class", "Weight", "x", "BRAND", ""], ["", "lg", "LG", "42 inch", "42inch", "10.5 lb", "10.5 lbs"]
    lists = [[]] + [[(keys[k], values[v]) for k, v in zip(rng.choice(8, n, False), rng.integers(0, 7, n))] for n in rng.integers(0, 5, 12)] + [[("Brand", "lg"), ("Brand", "x")], [("Brand", "x"), ("Brand Name", "lg"), ("Brand", "lg")]]
    f = stage(spark.createDataFrame(list(enumerate(lists)), f"f int, features {FEATURES}"), "testlists")
    gram = lambda c: F.transform(c, lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value"), S.qgrams(x["key"]).alias("kg"), S.qgrams(x["value"]).alias("vg")))
    both = f.crossJoin(f.toDF("g", "other")).withColumn("x", S.match_keys(gram(F.col("features")), gram(F.col("other")), F.lit(0.3)))
    want = {(r.f, r.g): (r.x.sim, r.x.w, r.x.m) for r in both.collect()}
    a = pa.array([[{"key": k, "low": k.lower(), "value": v.lower()} for k, v in x] for x in lists])
    sim, w, m = L.rate_features(0.3)(a, a)
    assert {(i, j): (sim[i, j], w[i, j], m[i, j]) for i in range(len(lists)) for j in range(len(lists))} == want


def test_degrees_make_no_pairs_of_classes(spark, monkeypatch):
    sigs = made_signatures(spark)
    settings = ((4, 1), (2, 2), (1, 4), (3, 1))
    want = [{r.offer_id: len(r.partners) for r in B.adjacency(B.lsh_pairs(sigs.withColumn("sig", F.slice("sig", 1, b * r)), b, r), sigs).collect()} for b, r in settings]
    with monkeypatch.context() as m:
        m.setattr(B, "class_pairs", None)
        assert [{r.offer_id: r.degree for r in B.degrees(sigs, b, r).collect()} for b, r in settings] == want
    monkeypatch.setattr(B, "MAX_BANDS", 0)
    assert {r.offer_id: r.degree for r in B.degrees(sigs, 4, 1).collect()} == want[0]
