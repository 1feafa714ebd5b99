import numpy as np
import pytest
from pyspark.sql import functions as F

from twinfold.functions import similarity as S
from twinfold.functions import text as T

FEATURES = "array<struct<key:string,value:string>>"


def value(spark, col, **cols):
    kinds = ", ".join(f"{k} {FEATURES if isinstance(v, list) else 'string'}" for k, v in cols.items()) or "none string"
    return spark.createDataFrame([tuple(cols.values()) or (None,)], kinds).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "brand"), [("Samsung Electronics Inc.", "samsung"), (" PANSONIC ", "panasonic"), ("Electronics Co", "unknown"), (None, "unknown"), ("TV LG", "tv lg")])
def test_normalize_brand(spark, raw, brand):
    assert value(spark, T.normalize_brand(F.col("s")), s=raw) == brand


def test_extract_brand_takes_the_smallest_key_and_no_second_try(spark):
    assert value(spark, T.extract_brand(F.col("f")), f=[("Brand Name", "LG"), ("Brand", "Electronics")]) == "unknown"
    assert value(spark, T.extract_brand(F.col("f")), f=[("Brand Name", "LG"), ("Brand", " ")]) == "lg"


@pytest.mark.parametrize(("raw", "clean"), [('Samsung 55" LED - 120Hz', "samsung 55inch led 120hz"), ("LG 47-inch LCD, 60 Hertz.", "lg 47inch lcd 60 hz"), ("55 inches", "55 inch"), ("55inches", "55inches"), ("400 cd/m²", "400 cd m2"), (None, "")])
def test_clean_title(spark, raw, clean):
    assert value(spark, T.clean_title(F.col("s")), s=raw) == clean


def test_words(spark):
    t = "samsung un55f6300 55inch led 120hz 1080p"
    words = value(spark, T.title_model_words(F.col("s")), s=t)
    assert set(words) == {"un55f6300", "55inch", "120hz", "1080p"}
    assert set(value(spark, T.with_numeric_parts(T.title_model_words(F.col("s"))), s=t)) == {*words, "55", "120", "1080"}
    assert value(spark, T.strong_words(F.col("s")), s=t) == ["un55f6300"]
    assert value(spark, T.pair_words(F.col("s")), s="sony kdl46 led") == []


@pytest.mark.parametrize(("word", "parts"), [("un55f6300", ("un", "55")), ("55inch", ("inch", "55")), ("120.5hz", (".", "120")), ("abc", ("abc", ""))])
def test_split_numeric(spark, word, parts):
    assert tuple(value(spark, T.split_numeric(F.col("s")), s=word)) == parts


@pytest.mark.parametrize(("title", "size"), [("sony 46inch 3d", 46.0), ("0.55inch", 55.0), ("5inch", None)])
def test_size(spark, title, size):
    assert value(spark, T.size_inches(F.col("s"), F.col("f")), s=title, f=[]) == size


def test_resolution(spark):
    assert value(spark, T.resolution(F.col("f")), f=[("Resolution", "1920x1080p"), ("Max resolution", "about 1920 x 1080")]) == "1920 x 1080"


@pytest.mark.parametrize(("a", "b", "lev", "q", "cos"), [("", "", 0, 0, 0), ("p", "hz", 0, None, 0), ("inch", "inch", 1, 1, 1), ("brand", "brand name", None, 0.5, None), ("", "x", 0, 0, 0), ("a b", "a c", None, None, 0.5)])
def test_similarities(spark, a, b, lev, q, cos):
    got = spark.createDataFrame([(a, b)], "a string, b string").select(S.norm_lev(F.col("a"), F.col("b")), S.qgram_similarity(F.col("a"), F.col("b")), S.cosine(S.terms(F.col("a")), S.terms(F.col("b")))).first()
    for x, want in zip(got, (lev, q, cos), strict=True):
        assert want is None or x == pytest.approx(want)


@pytest.mark.parametrize(("a", "b", "score"), [("x 55inch", "x 60inch", -1.0), ("foo un55f6300a", "bar un55f6300a", 1.0), ("un55f6300a", "kd55x9005b", -1.0)])
def test_title_score(spark, a, b, score):
    d = spark.createDataFrame([("1", a, "s1"), ("2", b, "s2")], "offer_id string, title string, shop string").withColumn("features", F.array().cast(FEATURES))
    p = S.profile(d)
    j = p.filter("offer_id = '1'").select(F.col("p").alias("p")).crossJoin(p.filter("offer_id = '2'").select(F.col("p").alias("q")))
    assert j.select(S.title_score(F.col("p"), F.col("q"), *[F.lit(x) for x in (0.6, 0.1, 0.5, 0.5)]).alias("x")).first()["x"] == score


def test_key_matching_is_greedy_and_one_to_one(spark):
    d = spark.createDataFrame([("1", [("brand", "lg"), ("brand name", "lg")]), ("2", [("brand name", "lg"), ("weight", "5 kg")])], f"offer_id string, features {FEATURES}").withColumns({"title": F.lit(""), "shop": F.lit("s")})
    p = S.profile(d)
    j = p.filter("offer_id = '1'").select(F.col("p").alias("p")).crossJoin(p.filter("offer_id = '2'").select(F.col("p").alias("q")))
    x = j.select(S.match_keys(F.col("p.f"), F.col("q.f"), F.lit(0.4)).alias("x")).first()["x"]
    assert (x["m"], x["w"], x["sim"], x["alone"], [r["key"] for r in x["rest"]]) == (1, 0.5, 0.5, ["lg"], ["weight"])


def test_texts_in_ascii_are_cleaned_as_all_texts(spark):
    rng = np.random.default_rng(5)
    parts = [s for s, _, _ in T.TITLE_RULES] + ["x", "7", "55", " ", "  ", "\t", "\n", "_", ".", "sandy", "Inches.", "KG )", "cd/m2 w", "-", "ſ", "K"]
    texts = ["".join(rng.choice(parts, int(rng.integers(0, 9)))) for _ in range(1500)]
    d = spark.createDataFrame([(x,) for x in texts], "s string")
    for rules in (T.TITLE_RULES, T.VALUE_RULES):
        got = d.select("s", T.clean(F.col("s"), rules).alias("got"), T._clean_any(F.lower("s"), rules).alias("want")).collect()
        assert [(r.s, r.got) for r in got] == [(r.s, r.want) for r in got]
    assert any(x.isascii() for x in texts) and not all(x.isascii() for x in texts)


def test_counted_cosine_is_cosine(spark):
    rows = [(a, b) for a in ("lg 42inch lg tv", "lg tv", "", "Tv tv tv lg", None) for b in ("tv lg", "lg lg", "42inch", "", "lg tv tv")]
    d = spark.createDataFrame(rows, "a string, b string")
    c = S.counted_cosine(S.counted_terms(F.col("a")), S.counted_terms(F.col("b")))
    for r in d.select(c.alias("x"), S.cosine(S.terms(F.col("a")), S.terms(F.col("b"))).alias("y")).collect():
        assert r.x == r.y
