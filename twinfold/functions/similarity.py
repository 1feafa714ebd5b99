"""Similarities as Column expressions; profile() computes once per offer what pairs need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import bind, pair_words, resolution, size_inches, split_numeric, strong_words, value_words


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.when(b == 0, F.lit(1)).otherwise(b))


def jaccard(a: Column, b: Column) -> Column:
    return ratio(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)))


def jaccard_sets(a: Column, b: Column) -> Column:
    """jaccard of arrays without repeats, with one pass over both."""
    return bind(F.size(F.array_intersect(a, b)), lambda n: F.coalesce(F.try_divide(n.cast("double"), F.size(a) + F.size(b) - n), F.lit(0.0)))


def terms(text: Column) -> Column:
    """Blank-separated words in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+"), lambda w: w != "")


def _count(words: Column, w: Column) -> Column:
    return F.size(F.filter(words, lambda x: x == w))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of words by their counts; 0 if either is empty."""
    total = lambda ws, f: F.aggregate(F.array_distinct(ws), F.lit(0.0), lambda acc, w: acc + f(w))
    dot = total(a, lambda w: _count(a, w) * _count(b, w))
    return ratio(dot, F.sqrt(total(a, lambda w: _count(a, w) * _count(a, w))) * F.sqrt(total(b, lambda w: _count(b, w) * _count(b, w))))


def counted_terms(text: Column) -> Column:
    """struct(words: terms, once: whether none is repeated, norm): what counted_cosine needs of a text."""
    square = lambda ws: F.aggregate(F.array_distinct(ws), F.lit(0.0), lambda acc, w: acc + _count(ws, w) * _count(ws, w))
    return bind(terms(text), lambda ws: F.struct(ws.alias("words"), (F.size(F.array_distinct(ws)) == F.size(ws)).alias("once"), F.sqrt(square(ws)).alias("norm")))


def counted_cosine(p: Column, q: Column) -> Column:
    """cosine of the words of counted_terms; words without repeats are intersected, not counted."""
    a, b = p["words"], q["words"]
    dot = F.aggregate(F.array_distinct(a), F.lit(0.0), lambda acc, w: acc + _count(a, w) * _count(b, w))
    return ratio(F.when(p["once"] & q["once"], F.size(F.array_intersect(a, b)).cast("double")).otherwise(dot), p["norm"] * q["norm"])


def qgrams(text: Column, q: int = 3) -> Column:
    """Distinct q-grams of the text in lower case with a blank at each end."""
    s = F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    n = F.length(s)
    return F.when(n >= q, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - q + 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(q))))).otherwise(F.array().cast("array<string>"))


def qgram_similarity(a: Column, b: Column, q: int = 3) -> Column:
    return jaccard_sets(qgrams(a, q), qgrams(b, q))


def norm_lev(a: Column, b: Column) -> Column:
    """One less the edit distance over the longer length; 0 for two empty texts."""
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / F.greatest(n, F.lit(1)))


def avg_lev(a: Column, b: Column) -> Column:
    """Mean norm_lev of all pairs of two arrays of words; 0 if either is empty."""
    total = F.aggregate(a, F.lit(0.0), lambda acc, x: F.aggregate(b, acc, lambda so_far, y: so_far + norm_lev(x, y)))
    return ratio(total, F.size(a) * F.size(b))


def profile(offers: DataFrame) -> DataFrame:
    """offer_id and p: what the pair score needs of an offer (shop, title, features of cleaned offers)."""
    title, f = F.col("title"), F.col("features")
    grams = F.transform(f, lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value"), qgrams(x["key"]).alias("kg"), qgrams(x["value"]).alias("vg")))
    return offers.select(
        "offer_id",
        F.struct(
            F.col("shop"), counted_terms(title).alias("terms"), pair_words(title).alias("words"), F.transform(pair_words(title), split_numeric).alias("parts"), strong_words(title).alias("strong"),
            resolution(f).alias("reso"), size_inches(title, f).alias("size"), grams.alias("f"),
        ).alias("p"),
    )


def short_profile(offers: DataFrame) -> DataFrame:
    """offer_id and p: the part of profile that the test for blocked pairs takes."""
    title, f = F.col("title"), F.col("features")
    return offers.select("offer_id", F.struct("shop", strong_words(title).alias("strong"), resolution(f).alias("reso"), size_inches(title, f).alias("size")).alias("p"))


def title_parts(title: Column) -> Column:
    """What title_score needs of a title."""
    words = pair_words(title)
    return F.struct(counted_terms(title).alias("terms"), words.alias("words"), F.transform(words, split_numeric).alias("parts"), strong_words(title).alias("strong"))


def shares_strong(p: Column, q: Column) -> Column:
    return F.arrays_overlap(p["strong"], q["strong"])


def blocked(p: Column, q: Column) -> Column:
    """Without a shared strong word: same shop, or different resolutions or sizes where both are known."""
    differ = lambda c: F.coalesce(p[c] != q[c], F.lit(False))
    return ~shares_strong(p, q) & (p["shop"].eqNullSafe(q["shop"]) | differ("reso") | differ("size"))


def title_score(p: Column, q: Column, alpha: Column, beta: Column, delta: Column, eta: Column) -> Column:
    """-1 if the titles tell different models, else their similarity."""
    cos = counted_cosine(p["terms"], q["terms"])
    alike = lambda same: F.exists(p["parts"], lambda a: F.exists(q["parts"], lambda b: (norm_lev(a["text"], b["text"]) > eta) & ((a["number"] == b["number"]) if same else (a["number"] != b["number"]))))
    plain = beta * cos + (1 - beta) * avg_lev(p["words"], q["words"])
    bare = lambda x: F.transform(x["parts"], lambda s: s["text"])
    return (
        F.when(shares_strong(p, q), 1.0)
        .when((F.size(p["strong"]) > 0) & (F.size(q["strong"]) > 0), -1.0)
        .when(cos > alpha, 1.0)
        .when(alike(False), -1.0)
        .when(alike(True), delta * avg_lev(bare(p), bare(q)) + (1 - delta) * plain)
        .otherwise(plain)
    )


def match_keys(f1: Column, f2: Column, gamma: Column) -> Column:
    """Greedy one-to-one matching of features: each of f1, in order, takes the first of f2 left whose key is similar enough.

    struct(rest: unmatched of f2, alone: values of unmatched f1, sim, w, m): sim sums key times value similarity, w key
    similarities, m counts.
    """
    start = F.struct(f2.alias("rest"), F.array().cast("array<string>").alias("alone"), F.lit(0.0).alias("sim"), F.lit(0.0).alias("w"), F.lit(0).alias("m"))

    def step(acc: Column, x: Column) -> Column:
        rated = F.transform(acc["rest"], lambda y: F.struct(y.alias("y"), jaccard_sets(x["kg"], y["kg"]).alias("s")))
        return bind(F.get(F.filter(rated, lambda z: z["s"] > gamma), F.lit(0)), lambda hit: take(acc, x, hit))

    def take(acc: Column, x: Column, hit: Column) -> Column:
        y, ks, found = hit["y"], hit["s"], hit.isNotNull()
        return F.struct(
            F.when(found, F.filter(acc["rest"], lambda z: z["key"] != y["key"])).otherwise(acc["rest"]).alias("rest"),
            F.when(found, acc["alone"]).otherwise(F.concat(acc["alone"], F.array(x["value"]))).alias("alone"),
            F.when(found, acc["sim"] + ks * jaccard_sets(x["vg"], y["vg"])).otherwise(acc["sim"]).alias("sim"),
            F.when(found, acc["w"] + ks).otherwise(acc["w"]).alias("w"),
            F.when(found, acc["m"] + 1).otherwise(acc["m"]).alias("m"),
        )

    return F.aggregate(f1, start, step)


def match_plan(k1: Column, k2: Column, gamma: Column) -> Column:
    """The matching of match_keys for lists of struct(i: place, key, kg), which keys alone decide: hits (i, j, s: key similarity), in order, and alone and rest: places not matched."""
    start = F.struct(k2.alias("rest"), F.array().cast("array<int>").alias("alone"), F.array().cast("array<struct<i:int,j:int,s:double>>").alias("hits"))

    def step(acc: Column, x: Column) -> Column:
        rated = F.transform(acc["rest"], lambda y: F.struct(y.alias("y"), jaccard_sets(x["kg"], y["kg"]).alias("s")))
        return bind(F.get(F.filter(rated, lambda z: z["s"] > gamma), F.lit(0)), lambda hit: take(acc, x, hit))

    def take(acc: Column, x: Column, hit: Column) -> Column:
        y, found = hit["y"], hit.isNotNull()
        return F.struct(
            F.when(found, F.filter(acc["rest"], lambda z: z["key"] != y["key"])).otherwise(acc["rest"]).alias("rest"),
            F.when(found, acc["alone"]).otherwise(F.concat(acc["alone"], F.array(x["i"]))).alias("alone"),
            F.when(found, F.concat(acc["hits"], F.array(F.struct(x["i"].alias("i"), y["i"].alias("j"), hit["s"].alias("s"))))).otherwise(acc["hits"]).alias("hits"),
        )

    done = F.aggregate(k1, start, step)
    return bind(done, lambda r: F.struct(r["hits"].alias("hits"), r["alone"].alias("alone"), F.transform(r["rest"], lambda y: y["i"]).alias("rest")))


def feature_score(mean: Column, words: Column, share: Column, title: Column, mu: Column) -> Column:
    """One less the weighted sum of feature, value-word and title similarity, of pairs that are not blocked."""
    theta = (1 - mu) * share
    with_title = theta * mean + (1 - mu - theta) * words + mu * title
    return 1 - F.when(title == -1, share * mean + (1 - share) * words).otherwise(with_title)


def pair_dissimilarity(p: Column, q: Column, match: Column, title: Column, mu: Column) -> Column:
    """1 where blocked, else one less the weighted sum of feature, value-word and title similarity."""
    mean = ratio(match["sim"], match["w"])
    words = jaccard(value_words(match["alone"]), value_words(F.transform(match["rest"], lambda y: y["value"])))
    share = match["m"] / F.greatest(F.lit(1), F.least(F.size(p["f"]), F.size(q["f"])))
    return F.when(blocked(p, q), 1.0).otherwise(feature_score(mean, words, share, title, mu))
