"""PII: keyed, format-preserving surrogates, in DataFrame functions only.

Detection is one regular expression; the text around entities is kept byte for byte. A surrogate is a keyed
permutation of all strings of the entity's shape (a four-round Feistel network whose steps turn each character
within its own alphabet: digits, Latin, accented Latin, Greek or Cyrillic letters, each in its case). So:
* coreference: the same entity, in whatever case or grouping of digits, has the same surrogate everywhere;
* distinctness: different entities of a type have different surrogates, at any scale, without a table of them;
* type: cards keep their first digit and a valid check digit, addresses are valid IPv4, phone numbers keep country
  code and grouping, mail addresses their top-level domain, names their title and, if known, a given name's gender.
Surrogates are still checked over all distinct entities of the corpus: should two entities share one, or one be its
own surrogate, all are drawn anew under the next key. Numbers that fail the card check are no entities.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodepath.llm.common import table, unused

ALPHABETS = (
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïñòóôõöøùúûüý", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
)
HEX = ("0123456789abcdef",)
MALE_TITLES, FEMALE_TITLES, OTHER_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Sir"), ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Lady"), ("Dr", "Prof")
GIVEN = {
    "male": "Adam Albert Anton Bruno Carlos Daniel David Diego Emil Felix Georg Hans Henri Hugo Ivan James John Jules Karl Louis Lucas Marco Martin Max Michael Oscar Otto Pablo Paul Peter Robert Simon Thomas Victor William".split(),
    "female": "Alice Anna Beatrice Carla Clara Claire Diana Elena Elisa Emma Eva Frieda Greta Hanna Helena Ines Irma Jane Julia Karin Laura Lena Lucia Lucy Maria Marie Marta Mary Nora Olga Paula Rosa Sara Sofia Sophie Vera".split(),
}
_titles = "|".join((*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES))
_octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
KINDS = {
    "mail": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]+\.)+\p{L}{2,}",
    "secret": r"(?<![\p{L}\p{N}])[0-9a-fA-F]{32,128}(?![\p{L}\p{N}])",
    "phone": r"(?<![\p{L}\p{N}+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\p{L}\p{N}])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)",
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7}[A-Z0-9]{0,16}(?![\p{L}\p{N}])",
    "address": rf"(?<![\p{{L}}\p{{N}}.]){_octet}(?:\.{_octet}){{3}}(?![\p{{L}}\p{{N}}]|\.\d)",
    "card": r"(?<![\p{L}\p{N}])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4})(?![\p{L}\p{N}])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{_titles})\.? \p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+)?",
}
#: Every kind begins where no letter or digit stands before; one look behind spares the others at most places.
PATTERN = r"(?<![\p{L}\p{N}])(?:" + "|".join(f"(?:{p})" for p in KINDS.values()) + ")"
#: A text without these has no entity. All start with one class of characters, so that most texts are passed over fast.
MAYBE = rf"[@0-9]|[{''.join(sorted({t[0] for t in (*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES)}))}](?:{'|'.join(sorted({t[1:] for t in (*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES)}))})\.? \p{{Lu}}|[a-fA-F]{{32}}"


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def turned(c: Column, by: Column, alphabets: tuple[str, ...]) -> Column:
    """The character `by` places on in its alphabet; others stay."""
    out = None
    for a in alphabets:
        at = F.instr(F.lit(a), c)
        value = F.substring(F.lit(a), F.pmod(at - 1 + by, F.lit(len(a))) + 1, F.lit(1))
        out = F.when(at > 0, value) if out is None else out.when(at > 0, value)
    return out.otherwise(c)


def step(s: Column, other: Column, salt: Column, alphabets: tuple[str, ...]) -> Column:
    """One Feistel step: each character of s turned by the keyed digest of the other half."""
    digest = F.sha2(F.concat_ws("|", salt, F.lower(other)), 256)
    return let(digest, lambda g: F.array_join(F.transform(chars(s), lambda c, i: turned(c, F.conv(F.substring(g, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int"), alphabets)), ""))


def permuted(s: Column, tweak: Column, alphabets: tuple[str, ...] = ALPHABETS) -> Column:
    """A keyed permutation of the strings of s's shape; tweak holds key, kind and what else the permutation depends on."""
    half = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substring(s, F.lit(1), half).alias("a"), F.substring(s, half + 1, F.length(s)).alias("b"))

    def turn(acc: Column, k: Column) -> Column:
        salt = F.concat_ws("|", tweak, k.cast("string"))
        even = k % 2 == 0
        return F.struct(
            F.when(even, step(acc["a"], acc["b"], salt, alphabets)).otherwise(acc["a"]).alias("a"),
            F.when(even, acc["b"]).otherwise(step(acc["b"], acc["a"], salt, alphabets)).alias("b"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(3)), start, turn, lambda acc: F.concat(acc["a"], acc["b"]))


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def refilled(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced, in order."""
    n = lambda i: F.length(digits_of(F.substring(shape, F.lit(1), i + 1)))
    return F.array_join(F.transform(chars(shape), lambda c, i: F.when(c.rlike(r"^\d$"), F.substring(digits, n(i), F.lit(1))).otherwise(c)), "")


def luhn_sum(digits: Column, doubled_from_right: int) -> Column:
    """Sum of the card check modulo 10; doubled_from_right: 0 if the last digit is doubled, 1 if the one before."""
    ds = F.transform(F.reverse(chars(digits)), lambda c, i: let(c.cast("int") * F.when(i % 2 == doubled_from_right, 2).otherwise(1), lambda v: v - F.when(v > 9, 9).otherwise(0)))
    return F.aggregate(ds, F.lit(0), lambda a, v: a + v) % 10


def surrogate(e: Column, key: str) -> Column:
    """The surrogate of an entity found by PATTERN."""
    tweak = lambda kind, *more: F.concat_ws("|", F.lit(key), F.lit(kind), *more)
    host = F.substring_index(e, "@", -1)
    top = F.substring_index(host, ".", -1)
    name = F.substring(host, F.lit(1), F.length(host) - F.length(top) - 1)
    local = F.substring(e, F.lit(1), F.length(e) - F.length(host) - 1)
    mail = F.concat(permuted(local, tweak("mail", F.lower(host))), F.lit("@"), permuted(name, tweak("host", F.lower(top))), F.lit("."), top)
    secret = let(permuted(F.lower(e), tweak("secret"), HEX), lambda s: F.when(e == F.upper(e), F.upper(s)).otherwise(s))
    code = F.regexp_extract(e, r"^\+(\d{1,3})(?=[ .(-])", 1)
    phone = let(digits_of(e), lambda d: let(F.length(code), lambda n: refilled(e, F.concat(F.substring(d, F.lit(1), n), permuted(F.substring(d, n + 1, F.length(d)), tweak("phone", code))))))
    ssn = refilled(e, permuted(digits_of(e), tweak("ssn")))
    iban = F.concat(F.substring(e, 1, 2), permuted(F.substring(e, F.lit(3), F.length(e)), tweak("iban", F.substring(e, 1, 2))))
    part = lambda i: F.split(e, r"\.")[i].cast("int")
    halves = F.struct((part(0) * 256 + part(1)).alias("a"), (part(2) * 256 + part(3)).alias("b"))
    draw = lambda x, k: F.conv(F.substring(F.sha2(F.concat_ws("|", tweak("address"), k.cast("string"), x.cast("string")), 256), 1, 8), 16, 10).cast("bigint")
    address = F.aggregate(
        F.sequence(F.lit(0), F.lit(3)), halves,
        lambda acc, k: F.struct(acc["b"].alias("a"), ((acc["a"] + draw(acc["b"], k)) % 65536).cast("int").alias("b")),
        lambda acc: F.concat_ws(".", *[F.floor(x / 256).cast("int").cast("string") if hi else (x % 256).cast("string") for x in (acc["a"], acc["b"]) for hi in (True, False)]),
    )

    def card(d: Column) -> Column:
        body = let(F.concat(F.substring(d, 1, 1), permuted(F.substring(d, F.lit(2), F.length(d) - 2), tweak("card", F.substring(d, 1, 1)))), lambda b: F.concat(b, F.pmod(10 - luhn_sum(b, 0), F.lit(10)).cast("string")))
        return F.when(luhn_sum(d, 1) == 0, refilled(e, body)).otherwise(e)

    words = F.split(e, " ")
    bare = F.regexp_replace(words[0], r"\.$", "")

    def given(w: Column) -> Column:
        pairs = [x for names in GIVEN.values() for x in zip(names, sorted(names, key=lambda n: hashlib.sha256(f"{key}|{n}".encode()).digest()), strict=True)]
        known = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
        return F.coalesce(known[w], permuted(w, tweak("family")))

    one, two = F.concat_ws(" ", words[0], permuted(words[1], tweak("family"))), F.concat_ws(" ", words[0], given(words[1]), permuted(words[2], tweak("family")))
    titled = F.when(F.size(words) == 3, two).otherwise(one)
    return (
        F.when(F.instr(e, "@") > 0, mail).when(e.rlike(r"^[0-9a-fA-F]{32,}$"), secret).when(e.rlike(r"^[+(]"), phone).when(e.rlike(KINDS["ssn"]), ssn)
        .when(e.rlike(r"^\d+(?:\.\d+){3}$"), address).when(e.rlike(r"^\d"), let(digits_of(e), card)).when(bare.isin(*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES), titled).otherwise(iban)
    )


def kind_of(e: Column) -> Column:
    return (
        F.when(F.instr(e, "@") > 0, "mail").when(e.rlike(r"^[0-9a-fA-F]{32,}$"), "secret").when(e.rlike(r"^[+(]"), "phone").when(e.rlike(KINDS["ssn"]), "ssn")
        .when(e.rlike(r"^\d+(?:\.\d+){3}$"), "address").when(e.rlike(r"^\d"), F.when(luhn_sum(digits_of(e), 1) == 0, "card")).when(F.instr(e, " ") > 0, "name").otherwise("iban")
    )


def entities(text: Column) -> Column:
    """All matches of PATTERN in order, numbers that fail the card check among them; empty for null."""
    return F.when(text.rlike(MAYBE), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def replaced(text: Column, found: Column, key: str) -> Column:
    """text with each of its entities() replaced; null stays null."""
    swapped = F.zip_with(F.split(text, PATTERN), F.transform(found, lambda e: surrogate(e, key)), lambda gap, s: F.concat(gap, F.coalesce(s, F.lit(""))))
    return F.when(F.size(found) > 0, F.array_join(swapped, "")).otherwise(text)


def faults(docs: DataFrame, key: str) -> DataFrame:
    """(kind, canonical, surrogate) of entities that share their surrogate with another or are their own; empty is right.

    Distinct entities are merged in the scan's tasks before they are shuffled, so frequent ones cost nothing."""
    found = docs.select(F.explode(entities(F.col("text").cast("string"))).alias("e")).distinct().withColumn("kind", kind_of(F.col("e"))).where("kind is not null")
    canon = F.when(F.col("kind").isin("card", "ssn"), digits_of(F.col("e"))).when(F.col("kind") == "phone", F.regexp_replace("e", r"[^\d+]", "")).otherwise(F.lower("e"))
    pairs = found.select("kind", canon.alias("canonical"), surrogate(F.col("e"), key).alias("s"))
    pairs = pairs.select("kind", "canonical", F.when(F.col("kind").isin("card", "ssn"), digits_of(F.col("s"))).when(F.col("kind") == "phone", F.regexp_replace("s", r"[^\d+]", "")).otherwise(F.lower("s")).alias("surrogate"))
    own = F.max((F.col("canonical") == F.col("surrogate")).cast("int"))
    return pairs.groupBy("kind", "surrogate").agg(F.min("canonical").alias("canonical"), F.max("canonical").alias("other"), own.alias("own")).where("canonical <> other or own = 1")


def checked_key(docs: DataFrame, key: str, attempts: int = 8) -> str:
    """The first of key, key#1, key#2 ... under which faults() finds none."""
    for k in range(attempts):
        now = key if not k else f"{key}#{k}"
        if not faults(docs, now).limit(1).count():
            return now
    raise RuntimeError(f"no key out of {attempts} gives distinct surrogates")


def pseudonymise(docs: DataFrame, key: str = "lodepath") -> DataFrame:
    """docs with `text` replaced; all other columns, whatever their names, as they were.

    Null texts stay null, empty ones empty; repeated rows get the same text; an empty table stays empty. Names
    without a title, and given names outside the lists' genders, aren't told from other words: the former stay,
    the latter get letters of the same shape."""
    text = F.col("text").cast("string")
    (found,) = unused(docs, "_found")
    return docs.withColumn(found, entities(text)).withColumn("text", replaced(text, F.col(found), checked_key(docs, key))).drop(found)


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_entities, text) of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.withColumn("_found", entities(F.col("text")))
    n = F.size(F.filter("_found", lambda e: kind_of(e).isNotNull())).alias("n_entities")
    return found.select("doc_id", n, replaced(F.col("text"), F.col("_found"), checked_key(docs, "lodepath")).alias("text"))
