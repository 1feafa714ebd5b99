import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinfold.llm import langid, quality, rules
from twinfold.llm.common import crc_mod, in_sample, sample_limit, table
from twinfold.llm.textstats import TextStats


def brute_repeat(words):
    n, hit = len(words), set()
    for i in range(n - 7):
        for j in range(n - 7):
            if i != j and words[i : i + 8] == words[j : j + 8]:
                hit |= set(range(i, i + 8))
    return len(hit)


def test_repeated_windows():
    rng = random.Random(4)
    for _ in range(60):
        words = [rng.choice("ab") for _ in range(rng.randint(0, 40))]
        assert TextStats(" ".join(words)).n_repeat_words == brute_repeat(words)


def test_order_is_by_rejections_per_cost_and_verdicts_do_not_depend_on_it():
    texts = ["# " * 30, "a b c d e f g h " * 9, None, "", "fine words " * 20] * 4
    order = rules.order_rules([rules.measure(t, rules.RULES) for t in texts], rules.RULES)
    assert rules.order_rules([], rules.RULES) == rules.RULES or set(rules.order_rules([], rules.RULES)) == set(rules.RULES)
    assert set(order) == set(rules.RULES)
    for t in texts:
        assert (rules.passes(TextStats(t), order) is None) == (rules.passes(TextStats(t), rules.RULES) is None)


def test_order_takes_rejections_per_second_and_then_what_is_left():
    a, b, c = (rules.Rule(x, lambda t: False) for x in "abc")
    measured = [([4.0, 1.0, 1.0], [True, True, False])] * 3 + [([4.0, 1.0, 1.0], [True, False, False])] + [([4.0, 1.0, 1.0], [False, False, True])] * 2
    assert [r.name for r in rules.order_rules(measured, (a, b, c))] == ["b", "c", "a"]


def test_what_a_rule_computes_beyond_the_base_statistics_can_be_skipped():
    t = TextStats("# " * 30)
    assert rules.passes(t, rules.RULES) == "symbols"
    assert "top_word" not in vars(t)


@pytest.mark.parametrize("n", [2 * 10**9, 10**11, 10**15])
def test_samples_of_large_tables_are_not_empty(n):
    for rows in (rules.SAMPLE_ROWS, langid.SAMPLE_PER_LANG, quality.SAMPLE_ROWS):
        assert sample_limit(rows, n) * n / 2**63 == pytest.approx(rows, rel=1e-3)
    assert sample_limit(10, 3) == 2**63 - 1


def test_sample_takes_about_what_it_should(spark):
    limit = sample_limit(500, 2 * 10**9)
    assert spark.range(10).filter(in_sample("id", limit)).count() <= 10
    assert 300 < spark.range(100_000).filter(in_sample("id", sample_limit(500, 100_000))).count() < 700


def test_cascade_on_odd_rows(odd_docs, no_docs):
    got = rules.cascade(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert all(r.base_failed and not r.kept for r in got if r.n_words < 20)
    assert rules.cascade(no_docs).count() == 0


def test_quality_rules_keep_good_documents(spark, sf_dir):
    got = rules.op9_quality_rules(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").toPandas()
    assert got[(got.quality == 1) & ~got.base_failed].kept.mean() > 0.95
    assert got[got.quality == 0].kept.mean() < 0.1


def test_language_accuracy_and_und(spark, sf_dir, odd_docs, no_docs):
    got = langid.op4_language_id(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.lang == got.lang_pred)[got.held_out].mean() > 0.95
    assert got.score.between(0, 1).all()
    odd = langid.identify(odd_docs, langid.learn(odd_docs)).collect()
    assert [r.lang_pred for r in odd if r.doc_id in (3, 4, 5, 8)] == ["und"] * 4
    assert {r.lang_pred for r in langid.identify(odd_docs, langid.learn(no_docs)).collect()} == {"und"}
    assert langid.identify(no_docs, {}).count() == 0


def test_distance_is_out_of_place():
    ranked = {"x": langid.grams("aaab")[0], "y": langid.grams("zzzy")[0]}
    lang, score = langid.Profiles(ranked).predict("aaab")
    assert (lang, score) == ("x", 1.0)
    assert langid.Profiles(ranked).predict("123 !!") == ("und", 0.0)


def test_pool_adjacent_violators():
    import numpy as np

    xs, ys = quality.pool(np.array([0.0, 1, 2, 3]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert ys.tolist() == [0.0, 0.5, 1.0]
    assert xs.tolist() == [0.0, 1.5, 3.0]


def test_quality_accuracy(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.01")
    got = quality.op5_quality(spark, d).join(table(spark, d, "labels"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.93
    assert got.score.between(0, 1).all()


def test_quality_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 1), (4, 0), (None, 1), (6, None), (5, 0), (77, 1)], "doc_id long, quality int")
    m = quality.fit(odd_docs, labels)
    assert quality.score(odd_docs, m).count() == odd_docs.count()
    assert quality.keep_good(odd_docs, m).columns == odd_docs.columns
    none = quality.fit(no_docs, labels)
    assert none is None
    assert {r.score for r in quality.score(odd_docs, none).collect()} == {0.5}
    assert quality.fit(odd_docs, labels.filter(F.lit(False))) is None


@pytest.mark.parametrize(("text", "crc"), [("0", 4108050209)])
def test_crc(spark, text, crc):
    assert spark.range(1).select(crc_mod(F.lit(0), 1000)).first()[0] == crc % 1000


def plain_grams(text):
    """n-grams of one to three letters, words padded by a blank, with counts."""
    letters = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    letters = " " + " ".join(letters.split()) + " "
    if not letters.strip():
        return []
    c = Counter(letters[i : i + n] for n in (1, 2, 3) for i in range(len(letters) - n + 1))
    del c[" "]
    return list(c.items())


def packed(gram):
    v = 0
    for ch in gram:
        v = v << langid.BITS | ord(ch)
    return v


def test_languages_equal_a_plain_version(spark, sf_dir):
    """The whole query by counting in dictionaries: profiles of all learned documents, ranks, distances."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows}
    rank = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], packed(x[0])))]
    counts = {}
    for r in rows:
        if r.text is not None and r.lang is not None and not held[r.doc_id]:
            counts.setdefault(r.lang, Counter()).update(dict(plain_grams(r.text)))
    profiles = {k: {g: i for i, g in enumerate(rank(c)[: langid.PROFILE])} for k, c in counts.items()}
    size = max(map(len, profiles.values()))
    got = {r.doc_id: r for r in langid.op4_language_id(spark, sf_dir).collect()}
    for r in rows:
        mine = rank(dict(plain_grams(r.text or "")))[: langid.DOC_GRAMS]
        away = {k: sum(min(abs(p[g] - i), size) if g in p else size for i, g in enumerate(mine)) for k, p in profiles.items()}
        best = min(sorted(away), key=away.get) if mine else "und"
        assert (got[r.doc_id].held_out, got[r.doc_id].lang_pred) == (held[r.doc_id], best)
        assert got[r.doc_id].score == pytest.approx(1 - away[best] / (size * len(mine)) if mine else 0.0)


def test_quality_equals_a_plain_version(spark, sf_dir):
    """The whole query on one array: features, kernel, ridge of all rows, isotonic steps on scores by the other folds' ridge."""
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    folds = {r.doc_id: r.f for r in table(spark, sf_dir, "documents").select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(quality.SEED + 1)), F.lit(quality.FOLDS)).alias("f")).collect()}
    known = [(r.doc_id, r.quality) for r in table(spark, sf_dir, "labels").collect() if r.quality is not None and r.doc_id in docs and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    x, y = np.array([quality.features(docs[d]) for d, _ in known]), np.array([q for _, q in known], dtype=float)
    fold = np.array([folds[d] for d, _ in known])
    rng = np.random.default_rng(quality.SEED)
    m = quality.Model(x.mean(0), np.maximum(x.std(0), 1e-3), rng.normal(size=(quality.N_FEATURES, quality.FREQUENCIES)) / np.sqrt(quality.N_FEATURES / 2))
    k = m.kernel(x)

    def ridge(at):
        return np.linalg.solve(k[at].T @ k[at] + quality.RIDGE * at.sum() * np.eye(k.shape[1]), k[at].T @ y[at])

    s = np.array([k[i] @ w for i, w in enumerate(np.stack([ridge(fold != f) for f in range(quality.FOLDS)])[fold])])
    bins = np.floor(np.clip(s, -0.5, 1.5) * quality.BINS)
    ids = np.unique(bins)
    m.xs, m.ys = quality.pool(*(np.array([f(bins == b) for b in ids]) for f in (lambda a: s[a].mean(), lambda a: y[a].mean(), lambda a: a.sum())))
    m.weights = ridge(np.ones(len(y), bool))
    for r in quality.op5_quality(spark, sf_dir).collect():
        want = float(np.clip(m.predict(np.array([quality.features(docs[r.doc_id])])), 0, 1)[0])
        assert r.score == pytest.approx(want, abs=1e-5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_ties_and_equal_texts_are_judged_alike(spark):
    rows = [(i, t, "de" if i % 2 else "en", i % 2) for i, t in enumerate(["same words here again " * 8] * 6 + ["other text stands there " * 9] * 6)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    ranked = langid.learn(d)
    assert len({(r.lang_pred, r.score) for r in langid.identify(d.filter("doc_id < 6"), ranked).collect()}) == 1
    assert {r.lang_pred for r in langid.identify(d, {"b": ranked["de"], "a": ranked["de"]}).collect()} == {"a"}
    m = quality.fit(d, d.select("doc_id", "quality"))
    assert len({r.score for r in quality.score(d.filter("doc_id < 6"), m).collect()}) == 1
    assert len({(r.kept, r.base_failed) for r in rules.cascade(d.filter("doc_id < 6")).collect()}) == 1
