"""Keyed surrogates for personal data. DataFrame functions only.

Detected entities are replaced by others of the same type, script and format: digits by digits, letters by letters of the same
alphabet and case, IPv4 octets by octets of the same width, card numbers with the same check sum, given names
by given names of their gender.

The replacement is a keyed permutation of the format: an entity's symbols (letters, digits, octets) keep their classes, and a
Feistel network of keyed hashes (SHA-256) shifts the symbols at even and odd places in turn. So two entities of one type never
share a surrogate, and an entity has the same one everywhere. What counts is the canonical form: letters in lower
case, numbers without punctuation; case and punctuation are those of each spelling. Names are replaced part by part, with or
without a form of address, so a surname alone becomes what it becomes beside a given name.

Collisions are checked over the corpus: where a surrogate is a real entity of the corpus, another key is tried, up to
ATTEMPTS times; the result must also differ from all surrogates settled before. What then still collides (a format
whose values nearly all occur, such as 1.2.3.4 with one-digit octets) keeps its first surrogate, which is distinct from all
others though some other entity's real value. Only entities that needed another key are joined back to their documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.similarity import bind
from .common import stage, table

KEY = "twinfold-surrogates"
#: Keys that are tried for an entity whose surrogate is real.
ATTEMPTS = 6
#: Rounds of the Feistel network.
ROUNDS = 4
#: Texts with such entities up to which the list of them is broadcast; beyond it is joined by a shuffle.
MAX_BROADCAST_TEXTS = 50_000

# Given names by gender, and forms of address.
FEMALE = (
    "Alice Amelia Andrea Angela Anna Barbara Carla Caroline Catherine Charlotte Clara Claire Diana Elena Elizabeth Emily Emma Eva Hannah Helen Irene Isabel Jane Jessica Joan Julia "
    "Karen Katharina Laura Lena Linda Lisa Lucia Margaret Maria Marie Marta Mary Monika Nora Patricia Paula Rachel Sandra Sarah Sofia Susan Teresa Ursula Victoria"
).split()
MALE = (
    "Adam Albert Alexander Andrew Anthony Benjamin Brian Bruno Carlos Charles Christian Daniel David Edward Emil Felix Francis Frank George Hans Henry Hugo Jack James Jean John Jonas "
    "Joseph Karl Kevin Leon Louis Lukas Mark Martin Michael Oscar Paul Peter Philip Richard Robert Simon Stefan Steven Thomas Victor Walter William Wolfgang"
).split()
TITLES = r"(?:Mrs?|Ms|Miss|Herrn?|Frau|Monsieur|Madame|Mme|Señora?|Sra?|Dr|Prof|Sir|Lady)"
# Patterns of the types, in the order in which they are tried.
_EDGE, _STOP = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_BARE_IBAN = r"[A-F]{2}[0-9]{14,32}" + _STOP  # an IBAN without blanks whose letters are hexadecimal digits
_PART = r"\p{Lu}[\p{L}'-]+"
_HEX = r"(?:[0-9A-Fa-f]{0,64}[A-Fa-f][0-9A-Fa-f]{15,64}|(?=[0-9]{0,16}[A-Fa-f])[0-9A-Fa-f]{16,128})"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "secret": _EDGE + r"(?:(?!" + _BARE_IBAN + r")" + _HEX + r"|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64})" + _STOP,
    "iban": _EDGE + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?" + _STOP,
    "phone": _EDGE + r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}" + _STOP,
    "card": _EDGE + r"[0-9](?:[ -]?[0-9]){12,18}" + _STOP,
    "ip": r"(?<![\p{L}\p{N}_.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[\p{L}\p{N}_])",
    "ssn": _EDGE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _STOP,
    "local_phone": _EDGE + r"(?:\([0-9]{2,4}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}" + _STOP,
    "name": _EDGE + r"(?=\p{Lu})(?:" + TITLES + rf"\.? {_PART}(?: {_PART})?|(?:" + "|".join(FEMALE + MALE) + rf") {_PART})",
}
ANY = "|".join(PATTERNS.values())
#: A text without a match of any of these has no entity: most texts are told by quick searches.
_NUMBERS = r"[0-9](?:[ .()-]{0,2}[0-9]){3}|[0-9A-Fa-f]{16}|gh[pousr]_|sk-|AKIA|[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"
_NAMES = _EDGE + r"(?=\p{Lu})(?:" + TITLES + r"\.?|" + "|".join(FEMALE + MALE) + r") \p{Lu}"

# Alphabets, in lower case, and ranges of letters of other scripts; a symbol is replaced by one of its own line.
ALPHABETS = (
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz",
    "àáâãäåæèéêëìíîïòóôõöøùúûüýÿœāăąēĕėęěĩīĭįōŏőũūŭůűų",
    "çñšžłńćčďđĝğġģĥħĵķĺļľņňŕŗřśŝşťţŵźż",
    "абвгдежзийклмнопрстуфхцчшщъыьэюяёђєѕіїјљњћќўџ",
    "αβγδεζηθικλμνξοπρστυφχψωάέήίόύώ",
)
RANGES = ((0x561, 0x586), (0x5D0, 0x5EA), (0x620, 0x64A), (0x905, 0x939), (0xE01, 0xE2E), (0x10D0, 0x10F0), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))
_ALL = "".join(ALPHABETS)
_HEX_LETTERS = "abcdef"  # behind _ALL, for hexadecimal secrets
_MARK = "﷐"  # a code point that is no character, around entities


def type_of(e: Column) -> Column:
    """The first type whose pattern the whole entity matches."""
    out: Column = F.lit("other")
    for name, p in reversed(PATTERNS.items()):
        out = F.when(e.rlike(f"^(?:{p})$"), name).otherwise(out)
    return out


def _symbol(base: Column | int, radix: Column | int, index: Column | int) -> Column:
    one = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("int")
    return F.struct(one(base).alias("base"), one(radix).alias("radix"), one(index).alias("index"))


def _letter(c: Column) -> Column:
    """Class of a character: where its alphabet begins (in _ALL, or less the first code point), its size, and the character's place. Punctuation has size 1."""

    def of(low: Column) -> Column:
        def placed(at: Column) -> Column:
            cp = F.ascii(low)
            block = cp - cp % 16
            out = F.when(low.rlike(r"^\p{L}$"), _symbol(-block, 16, cp % 16)).otherwise(_symbol(0, 1, 0))
            for a, b in reversed(RANGES):
                out = F.when(cp.between(a, b), _symbol(-a, b - a + 1, cp - a)).otherwise(out)
            end = len(_ALL)
            for x in reversed(ALPHABETS):
                start = end - len(x)
                out = F.when((at > start) & (at <= end), _symbol(start, len(x), at - 1 - start)).otherwise(out)
                end = start
            return out

        return bind(F.instr(F.lit(_ALL), low), placed)

    return bind(F.lower(c), of)


def _octet(c: Column) -> Column:
    """Class of an octet: numbers of as many digits, up to 255 or above; those with a zero before stay."""
    v, n = c.cast("int"), F.length(c)
    return F.when(n == 1, _symbol(0, 10, v)).when((n == 2) & (v >= 10), _symbol(10, 90, v - 10)).when((n == 3) & v.between(100, 255), _symbol(100, 156, v - 100)).when((n == 3) & (v > 255), _symbol(256, 744, v - 256)).otherwise(_symbol(0, 1, 0))


def _spell(c: Column, base: Column, index: Column) -> Column:
    """The character at that place of its alphabet, in the case of c."""
    other = F.decode(F.unhex(F.lpad(F.hex((index - base).cast("long")), 8, "0")), "UTF-32")
    low = F.when(base >= 0, F.substring(F.lit(_ALL + _HEX_LETTERS), base + index + 1, F.lit(1))).otherwise(other)
    return F.when(c != F.lower(c), F.upper(low)).otherwise(low)


def _round(r: int, radix: Column, seed: Column) -> Callable[[Column], Column]:
    """Shifts the places at even or odd positions, by a keyed hash of the others."""
    mine = lambda i: i % 2 == r % 2

    def step(v: Column) -> Column:
        other = F.array_join(F.transform(v, lambda x, i: F.when(mine(i), "").otherwise(x.cast("string"))), ",")
        moved = lambda h: F.transform(v, lambda x, i: F.when(mine(i), F.pmod(x + F.pmod(F.xxhash64(h, i), F.get(radix, i)), F.get(radix, i)).cast("int")).otherwise(x))
        return bind(F.sha2(F.concat(seed, F.lit(f"|{r}|"), other), 256), moved)

    return step


def _feistel(index: Column, radix: Column, seed: Column) -> Column:
    """Places shifted within their classes, those at even and at odd positions in turn: a permutation of all arrays of these sizes."""
    for r in range(ROUNDS):
        index = bind(index, _round(r, radix, seed))
    return index


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo ten of an array of digits; the last counts once."""
    n = F.size(digits)
    value = F.transform(digits, lambda c, i: bind(c.cast("int"), lambda x: F.when((n - i) % 2 == 1, x).when(x > 4, x * 2 - 9).otherwise(x * 2)))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x) % 10


#: What is a symbol of a type; all else stays in its place.
_SYMBOLS = {"phone": "[0-9]", "local_phone": "[0-9]", "ssn": "[0-9]", "card": "[0-9]", "iban": "[A-Za-z0-9]", "ip": "[0-9]+"}
_CHARACTER = r"(?s)."


def _symbols(text: Column, kind: Column, f: Callable[[str], Column]) -> Column:
    out = f(_CHARACTER)
    for k, p in _SYMBOLS.items():
        out = F.when(kind == k, f(p)).otherwise(out)
    return out


def unit_key(u: Column) -> Column:
    """Type and canonical form of a unit."""
    text = _symbols(u["text"], u["kind"], lambda p: u["text"] if p == _CHARACTER else F.array_join(F.regexp_extract_all(u["text"], F.lit(p), F.lit(0)), "." if p == "[0-9]+" else ""))
    return F.concat(u["kind"], F.lit(":"), F.lower(text))


def _given(text: Column, seed: Column) -> Column:
    """A given name of the lists moved along the list of its gender; null for others."""
    out = F.lit(None).cast("string")
    for names in (FEMALE, MALE):
        ordered = sorted(names)
        at = F.array_position(F.array(*map(F.lit, ordered)), F.initcap(text)).cast("int")
        moved = F.element_at(F.array(*map(F.lit, ordered)), (F.pmod(at - 1 + 1 + F.pmod(F.xxhash64(F.sha2(seed, 256)), F.lit(len(ordered) - 1)), F.lit(len(ordered))) + 1).cast("int"))
        out = F.when(at > 0, F.when(text == F.upper(text), F.upper(moved)).when(text == F.lower(text), F.lower(moved)).otherwise(moved)).otherwise(out)
    return out


def unit_surrogate(u: Column, attempt: Column, key: str = KEY) -> Column:
    """The replacement of a unit (struct of kind and text) with the key of an attempt."""
    seed = F.concat(F.lit(f"{key}|"), u["kind"], F.lit("|"), attempt.cast("string"))
    return bind(F.struct(u["kind"].alias("kind"), u["text"].alias("text"), seed.alias("seed")), _replaced)


def _replaced(u: Column) -> Column:
    """The replacement of a unit with its seed; every part is named once, so that plans stay small."""
    text, kind, seed = u["text"], u["kind"], u["seed"]
    found = _symbols(text, kind, lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0)))
    between = _symbols(text, kind, lambda p: F.split(text, p, -1))
    last_kept = kind.isin("card", "given")
    skip = F.when(kind == "phone", 1).when((kind == "secret") & text.rlike("^(?:AKIA|gh[pousr]_)"), 4).when((kind == "secret") & text.startswith("sk-"), 3).otherwise(0)

    is_hex = (kind == "secret") & text.rlike("^[0-9A-Fa-f]+$")

    def replaced(old: Column) -> Column:
        n = F.size(old)
        kept = lambda i: (i < skip) | (last_kept & (i == n - 1) & (n > 1))
        classes = F.transform(old, lambda c, i: F.when(kept(i), _symbol(0, 1, 0)).when(kind == "ip", _octet(c)).when(is_hex & c.rlike("[A-Fa-f]"), _symbol(len(_ALL), len(_HEX_LETTERS), F.ascii(F.lower(c)) - 97)).otherwise(_letter(c)))

        def spelled(s: Column) -> Column:
            def back(moved: Column) -> Column:
                one = lambda c, i: F.when(F.get(s, i)["radix"] == 1, c).when(kind == "ip", (F.get(s, i)["base"] + F.get(moved, i)).cast("string")).otherwise(_spell(c, F.get(s, i)["base"], F.get(moved, i)))
                return F.transform(old, one)

            return bind(_feistel(s["index"], s["radix"], seed), back)

        def checked(new: Column) -> Column:
            """The check digit of a card makes up for what the others changed."""
            digit = lambda: ((F.element_at(old, -1).cast("int") + _luhn(old) - _luhn(new) + 10) % 10).cast("string")
            fixed = F.when(kind == "card", F.concat(F.slice(new, F.lit(1), n - 1), F.array(digit()))).otherwise(new)
            return F.array_join(F.flatten(F.zip_with(between, fixed, lambda b, x: F.array(F.coalesce(b, F.lit("")), F.coalesce(x, F.lit(""))))), "")

        return bind(bind(classes, spelled), checked)

    return F.coalesce(F.when(kind == "given", _given(text, seed)), bind(found, replaced))


def units(e: Column) -> Column:
    """What of an entity is replaced, as array of struct(kind, text): the parts of a name, else the whole."""
    unit = lambda kind, text: F.struct((kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"), text.alias("text"))

    def of(kind: Column) -> Column:
        parts = F.split(F.regexp_replace(e, rf"^{TITLES}\.? ", ""), " ")
        name = F.when(F.size(parts) > 1, F.array(unit("given", F.get(parts, F.lit(0))), unit("surname", F.get(parts, F.lit(1))))).otherwise(F.array(unit("surname", F.get(parts, F.lit(0)))))
        return F.when(kind == "name", name).otherwise(F.array(unit(kind, e)))

    return bind(type_of(e), of)


def surrogate(e: Column, attempt: Callable[[Column], Column], key: str = KEY) -> Column:
    """The replacement of an entity; attempt gives that of a unit's key."""

    def of(us: Column) -> Column:
        form = F.when(F.get(us, F.lit(0))["kind"].isin("given", "surname"), F.regexp_extract(e, rf"^{TITLES}\.? ", 0)).otherwise("")
        return F.concat(form, F.array_join(F.transform(us, lambda u: bind(u, lambda u: unit_surrogate(u, attempt(unit_key(u)), key))), " "))

    return bind(units(e), of)


def _suspect(text: Column) -> Column:
    return text.contains("@") | text.rlike(_NUMBERS) | text.rlike(_NAMES)


def split_text(text: Column) -> Column:
    """The text cut at its entities: those are at the odd places (from 0). One search of the text, unless it holds the mark."""
    marked = F.split(F.regexp_replace(text, f"({ANY})", f"{_MARK}$1{_MARK}"), _MARK, -1)
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    plain = F.flatten(F.zip_with(F.split(text, ANY, -1), found, lambda p, x: F.when(x.isNull(), F.array(p)).otherwise(F.array(p, x))))
    return F.when(~_suspect(text), F.array(text)).when(text.contains(_MARK), plain).otherwise(marked)


def entities(text: Column) -> Column:
    """All entities of a text, in order; none for null."""
    return F.when(text.isNotNull(), F.filter(split_text(text), lambda x, i: i % 2 == 1)).otherwise(F.array().cast("array<string>"))


def retries(docs: DataFrame, key: str = KEY, attempts: int = ATTEMPTS) -> tuple[DataFrame, DataFrame]:
    """found: (t, e), hash of each text with entities and its entities; again: (k, attempt) of the units whose first surrogate is real.

    Units are dealt over tasks by a hash of their key.
    """
    found = docs.select(F.xxhash64("text").alias("t"), entities(F.col("text")).alias("es")).filter(F.size("es") > 0)
    found = stage(found.select("t", F.explode("es").alias("e")).distinct(), "entities")
    every = found.select(F.explode(units(F.col("e"))).alias("u")).select(unit_key(F.col("u")).alias("k"), "u").groupBy("k").agg(F.min("u").alias("u"))
    known = stage(every, "units")

    def tried(rows: DataFrame, attempt: int) -> DataFrame:
        one = F.struct(F.col("u.kind").alias("kind"), unit_surrogate(F.col("u"), F.lit(attempt), key).alias("text"))
        listed = lambda u: (u["kind"] == "given") & F.initcap(u["text"]).isin(*FEMALE, *MALE)
        new = bind(one, lambda x: F.struct(unit_key(x).alias("s"), listed(x).alias("listed")))
        made = rows.select("k", "u", new.alias("x"), listed(F.col("u")).alias("fixed"))
        return made.select("k", "u", "x.s", (F.col("x.listed") & ~F.col("fixed")).alias("taken"), "fixed")

    first = stage(tried(known.repartition("k"), 0), "surrogates")
    real = known.select(F.col("k").alias("s"))
    # a listed given name moves along its list and collides with no other; an unlisted one must not become a listed one
    left = stage(first.filter("not fixed").join(real, "s", "left_semi").unionByName(first.filter("taken and not fixed")).select("k", "u").distinct(), "clashes")
    done = None
    used = first.select("s").join(real, "s", "left_anti")
    for attempt in range(1, attempts):
        if left.isEmpty():
            break
        new = stage(tried(left, attempt), "surrogates")
        taken = used if done is None else used.unionByName(done.select("s"))
        fine = new.filter("not taken").join(real, "s", "left_anti").join(taken, "s", "left_anti")
        fine = stage(fine.select("k", "s", F.lit(attempt).alias("attempt")), "settled")
        done = fine if done is None else done.unionByName(fine)
        left = stage(left.join(fine.select("k"), "k", "left_anti"), "clashes")
    again = docs.sparkSession.createDataFrame([], "k string, attempt int") if done is None else done.select("k", "attempt")
    return found, again


def replace_entities(docs: DataFrame, key: str = KEY) -> DataFrame:
    """The rows and columns of docs with surrogates in text, and n_entities (long). Null text stays null and has none.

    Equal texts get equal results, in whatever row; ids are not used. Works on whole texts. Where docs have a column
    n_entities, it stays as it is and the count is not given. An empty table gives no row.
    """
    found, again = retries(docs, key)
    # names that docs cannot have by chance
    each = docs.withColumn("__cut", split_text(F.col("text")))
    if again.isEmpty():
        each = each.withColumn("__again", F.lit(None).cast("map<string,int>"))
    else:
        own = found.select("t", F.explode(units(F.col("e"))).alias("u")).select("t", unit_key(F.col("u")).alias("k")).distinct().join(again, "k")
        own = stage(own.groupBy(F.col("t").alias("__t")).agg(F.map_from_entries(F.collect_set(F.struct("k", "attempt"))).alias("__again")), "again")
        each = each.withColumn("__t", F.xxhash64("text")).join(F.broadcast(own) if own.count() <= MAX_BROADCAST_TEXTS else own, "__t", "left").drop("__t")
    attempt = lambda k: F.when(F.col("__again").isNull(), 0).otherwise(F.coalesce(F.try_element_at(F.col("__again"), k), F.lit(0)))
    joined = F.array_join(F.transform("__cut", lambda x, i: F.when(i % 2 == 1, surrogate(x, attempt, key)).otherwise(x)), "")
    n = F.coalesce(F.floor(F.size("__cut") / 2), F.lit(0))
    text = F.when(F.size("__cut") > 1, joined).otherwise(F.col("text"))
    count = [] if "n_entities" in docs.columns else [F.when(F.col("text").isNull(), 0).otherwise(n).cast("long").alias("n_entities")]
    return each.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns], *count)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"))
