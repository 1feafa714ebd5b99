"""Scalar functions over offers' texts, as Column expressions. Features are array<struct<key,value>>, in order."""

from __future__ import annotations

import re
from functools import reduce
from itertools import groupby
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tables import BRAND_ENDINGS, INCHES, NUMBER, RESOLUTION, SIZE_KEYS, STRONG_WORD, TITLE_NOISE, TITLE_WORD, UNITS, VALUE_WORD

UNKNOWN = "unknown"
#: Brands in one alternation; more are matched by several.
BRANDS_PER_PATTERN = 400


def strip(c: Column) -> Column:
    """Without white space, of any script, at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def rule_list(units: dict[str, tuple[str, ...]]) -> list[tuple[str, str, bool]]:
    """(spelling, replacement, whole word only), longest spellings of a unit first."""
    return [(s, unit, s.isalpha()) for unit, spellings in units.items() for s in sorted(spellings, key=lambda x: -len(x))]


VALUE_RULES = rule_list(UNITS)
TITLE_RULES = rule_list(UNITS | {" ": TITLE_NOISE})


def bind(x: Column, f) -> Column:  # noqa: ANN001
    """f(x) with x computed once, also inside higher-order functions."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def clean(text: Column, rules: list[tuple[str, str, bool]]) -> Column:
    """Lower case, units respelled rule after rule, no punctuation at the end, single spaces; null is empty."""
    return bind(F.lower(F.coalesce(text, F.lit(""))), lambda x: F.when(F.octet_length(x) == F.length(x), _clean_ascii(x, rules)).otherwise(_clean_any(x, rules)))


def _clean_ascii(out: Column, rules: list[tuple[str, str, bool]]) -> Column:
    """_clean_any for ASCII in lower case: a unit's patterns are only searched for in texts that hold one of its spellings. Units are ASCII, so the text stays so."""

    def respell(spelling: str, unit: str, word: bool):  # noqa: ANN202
        return lambda x: F.when(x.contains(F.lit(spelling)), F.regexp_replace(x, rf"\b{spelling}\b", unit) if word else F.replace(x, F.lit(spelling), F.lit(unit))).otherwise(x)

    def respell_all(own: list[tuple[str, str, bool]]):  # noqa: ANN202
        least = [s for s, _, _ in own if not any(o != s and o in s for o, _, _ in own)]  # any other spelling holds one of these
        return lambda x: F.when(reduce(or_, [x.contains(F.lit(s)) for s in least]), reduce(lambda y, r: bind(y, respell(*r)), own, x)).otherwise(x)

    for _, own in groupby([(s.lower(), unit, word) for s, unit, word in rules if s.isascii()], key=lambda r: r[1]):
        out = bind(out, respell_all(list(own)))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[^0-9a-z]+\z", ""), r"\s+", " "))


def _clean_any(out: Column, rules: list[tuple[str, str, bool]]) -> Column:
    for spelling, unit, word in rules:
        p = "".join(f"\\x{{{ord(ch):x}}}" if not ch.isalnum() or ord(ch) > 127 else ch for ch in spelling)
        out = F.regexp_replace(out, rf"(?iU)\b{p}\b" if word else f"(?iU){p}", unit)
    return strip(F.regexp_replace(F.regexp_replace(out, r"[^0-9a-zA-Z]+\z", ""), r"(?U)\s+", " "))


def clean_title(title: Column) -> Column:
    return clean(title, TITLE_RULES)


def clean_value(value: Column) -> Column:
    return clean(value, VALUE_RULES)


def clean_features(features: Column) -> Column:
    """Values cleaned, keys as they are."""
    return F.transform(F.coalesce(features, F.array().cast("array<struct<key:string,value:string>>")), lambda f: F.struct(f["key"].alias("key"), clean_value(f["value"]).alias("value")))


def normalize_brand(raw: Column) -> Column:
    """A brand in lower case without punctuation and without endings such as inc; else unknown."""
    spaced = strip(F.regexp_replace(F.regexp_replace(F.lower(raw), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))
    words = F.filter(F.split(spaced, " "), lambda w: w != "")
    upto = F.array_max(F.transform(words, lambda w, i: F.when(w.isin(*BRAND_ENDINGS), 0).otherwise(i + 1)))
    name = F.array_join(F.slice(words, F.lit(1), F.coalesce(upto, F.lit(0))), " ")
    return F.when(strip(F.lower(raw)) == "pansonic", "panasonic").when(F.coalesce(name, F.lit("")) == "", UNKNOWN).otherwise(name)


def brand_value(features: Column) -> Column:
    """Value of the feature with the smallest key that holds 'brand' and has a value; null if none."""
    about = F.sort_array(F.filter(features, lambda f: f["key"].rlike("(?i)brand")))
    return F.get(F.filter(F.transform(about, lambda f: strip(f["value"])), lambda v: v != ""), F.lit(0))


def extract_brand(features: Column) -> Column:
    """Brand in brand_value, which decides even if unknown."""
    return F.coalesce(normalize_brand(brand_value(features)), F.lit(UNKNOWN))


def guess_brand(title: Column, brands: list[str]) -> Column:
    """The leftmost brand in the title, the longest of those at its place, as the title spells it; else unknown."""
    ordered = sorted(set(brands), key=lambda b: (-len(b), b))
    parts = [ordered[i : i + BRANDS_PER_PATTERN] for i in range(0, len(ordered), BRANDS_PER_PATTERN)]
    if not parts:
        return F.lit(UNKNOWN)
    pats = [r"(?iU)\b(?:" + "|".join(re.escape(b) for b in p) + r")\b" for p in parts]
    found = F.array(*[F.struct(F.regexp_instr(title, F.lit(p)).alias("at"), (-F.length(F.regexp_extract(title, p, 0))).alias("short"), F.regexp_extract(title, p, 0).alias("brand")) for p in pats])
    best = F.array_min(F.filter(found, lambda s: s["at"] > 0))["brand"]
    return F.coalesce(strip(best), F.lit(UNKNOWN))


def numbers(text: Column) -> Column:
    """All numbers in a text, letters behind them dropped."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0))


def feature_numbers(features: Column) -> Column:
    """Distinct numbers of all values, in string order."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(features, lambda f: numbers(f["value"])))))


def title_model_words(title: Column) -> Column:
    """Distinct words of a cleaned title with a letter and a digit."""
    words = F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(r"(?U)\w+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: w.rlike("^[a-zA-Z0-9]+$") & w.rlike("[a-zA-Z]") & w.rlike("[0-9]")))


def with_numeric_parts(words: Column) -> Column:
    """The words, and the numbers that they start with."""
    heads = lambda ws: F.filter(F.transform(ws, lambda w: F.regexp_extract(w, f"^{NUMBER}", 0)), lambda x: x != "")
    return bind(words, lambda ws: F.array_union(ws, heads(ws)))


def shingles(title: Column, features: Column) -> Column:
    """Model words of the title with their numbers, and the numbers of the features."""
    return F.array_union(with_numeric_parts(title_model_words(title)), feature_numbers(features))


def pair_words(title: Column) -> Column:
    """Distinct words of the pair score: a digit that a non-digit follows, and what clings to it."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(TITLE_WORD), F.lit(1)))


def strong_words(title: Column) -> Column:
    """Those pair words that identify a model, in lower case."""
    return F.array_distinct(F.transform(F.filter(pair_words(title), lambda w: w.rlike(STRONG_WORD)), F.lower))


def split_numeric(word: Column) -> Column:
    """struct(text, number): a leading number and what follows, else a leading text and its number, else the word."""
    w = F.lower(word)
    lead, tail = r"^(\d+)(\D*)", r"^(\D+)(\d+)"
    ex = lambda p, i: F.regexp_extract(w, p, i)
    text = F.when(w.rlike(lead), ex(lead, 2)).when(w.rlike(tail), ex(tail, 1)).otherwise(w)
    number = F.when(w.rlike(lead), ex(lead, 1)).when(w.rlike(tail), ex(tail, 2)).otherwise("")
    return F.struct(text.alias("text"), number.alias("number"))


def _inches(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), INCHES, 1), F.lit("")).cast("double")


def size_inches(title: Column, features: Column) -> Column:
    """Screen size in the title, else in the first feature about size that has one; null if none."""
    about = F.filter(features, lambda f: F.exists(F.array(*map(F.lit, SIZE_KEYS)), lambda k: F.lower(f["key"]).contains(k)))
    found = F.filter(F.transform(about, lambda f: _inches(f["value"])), lambda x: x.isNotNull())
    return F.coalesce(_inches(title), F.get(found, F.lit(0)))


def resolution(features: Column) -> Column:
    """Text of the first resolution in a feature about resolution; null if none."""
    about = F.filter(features, lambda f: F.lower(f["key"]).contains("resolution"))
    found = F.filter(F.transform(about, lambda f: F.regexp_extract(f["value"], RESOLUTION, 0)), lambda x: x != "")
    return F.get(found, F.lit(0))


def value_words(values: Column) -> Column:
    """Distinct decimals, ratios and resolutions in an array of values."""
    return F.array_distinct(F.flatten(F.transform(values, lambda v: F.regexp_extract_all(F.coalesce(v, F.lit("")), F.lit(VALUE_WORD), F.lit(0)))))
