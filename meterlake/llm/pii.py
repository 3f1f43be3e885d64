"""PII surrogates on built-in functions only.

Detected entities: e-mail addresses, phone numbers, IPv4 addresses, payment cards, social
security numbers, IBANs, and names behind a title. Each gets a keyed replacement of the same
type and format: numbers pass a keyed Feistel permutation of their digits (a bijection, so
different numbers of one length stay different; Luhn-valid cards and IBANs with right check
digits stay valid, IPv4 stays IPv4), separators stay, letters keep their script, names keep title and gender. The same
entity gets the same surrogate everywhere.

Collision checks run over all distinct entities: a surrogate that equals a real entity of
the corpus, or the surrogate of another entity, is drawn again with the next attempt number
until none is left. Entities are counted map-side before they meet, and attempts above
zero (rare) are joined back by text.

Defined results: NULL texts stay NULL, empty texts stay empty, texts without entities are
unchanged; repeated rows get equal results; other columns pass through; the key decides all
replacements, so equal keys give equal output; other columns may have any names; very long
texts, addresses and hosts are replaced whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import cut, unused

EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
NAME = (r"(?<![\p{L}])(?:Mrs|Mr|Miss|Ms|Herr|Frau|Mme|Madame|Monsieur|Señora|Señor|Dr|Prof|г-н|г-жа)\.?\x20"
        r"\p{Lu}[\p{L}'’-]{1,40}(?:\x20\p{Lu}[\p{L}'’-]{1,40})?")
IP = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\d|\.\d)"
SSN = r"\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}])"
CARD = r"\d(?:[\x20-]?\d){12,18}(?![\p{L}\p{N}])"
PHONE = (r"(?:\+\d{1,3}[\x20.-]?)?\(\d{2,4}\)[\x20.-]?\d{3,4}[\x20.-]?\d{3,4}(?!\d)|"
         r"(?:\+\d{1,3}[\x20.-])?\d{3}[.-]\d{3}[.-]\d{4}(?!\d)|\+\d{1,3}(?:[\x20.-]?\d{2,4}){2,5}(?!\d|\.\d)")
NUMBER = rf"(?=[+(\d])(?<![\p{{L}}\p{{N}}+])(?<![\d][.-])(?:{IP}|{SSN}|{CARD}|{PHONE})"
ENTITY = f"{EMAIL}|{NUMBER}|{IBAN}|{NAME}"

TYPES = ("email", "ip", "ssn", "card", "iban", "name", "phone")

MALE = "James Robert John Michael David Thomas Daniel Paul Mark Peter Lukas Felix Louis Hugo Carlos Diego"
FEMALE = "Mary Linda Susan Karen Emma Laura Anna Julia Claire Marie Lea Sofia Elena Carmen Lucia Alice"
MALE_CYRILLIC = "Иван Олег Павел Борис Антон Игорь Роман Денис"
FEMALE_CYRILLIC = "Анна Ольга Мария Елена Ирина Дарья Вера Нина"
LATIN = "".join(c + v for c in "bdfgklmnprstvz" for v in "aeiou")
CYRILLIC = "".join(c + v for c in "бвгдзклмнпрст" for v in "аеиоу")
ROUNDS = 6


def entity_type(x: Column) -> Column:
    return F.when(x.contains("@"), "email").when(x.rlike(f"^(?:{IP})$"), "ip").when(x.rlike(f"^(?:{SSN})$"), "ssn") \
        .when(x.rlike(f"^(?:{CARD})$"), "card").when(x.rlike(r"^[A-Z]{2}\d{2}"), "iban") \
        .when(x.rlike(r"^\p{L}"), "name").otherwise("phone")


def canonical(x: Column) -> Column:
    """What makes two spellings one entity: letters without case, numbers without separators."""
    return F.when(entity_type(x).isin("email", "name"), F.lower(x)).when(entity_type(x) == "ip", x) \
        .otherwise(F.regexp_replace(x, r"[^A-Z0-9]", ""))


def _hash(key: str, *parts) -> Column:
    """60 keyed bits as a long."""
    text = F.concat_ws("|", F.lit(key), *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("long")


def _permute(digits: Column, key: str, salt: Column) -> Column:
    """Keyed permutation of the digit strings of one length: alternating Feistel on the two halves."""
    n = F.length(digits)
    a = F.floor(n / 2).cast("int")
    ten = lambda k: F.pow(F.lit(10.0), k).cast("long")
    start = F.struct(F.when(a > 0, F.substr(digits, F.lit(1), a)).otherwise("0").cast("long").alias("l"),
                     F.substr(digits, a + 1, n - a).cast("long").alias("r"))

    def turn(s, i):
        to_left = F.pmod(s["l"] + F.pmod(_hash(key, salt, n, i, s["r"]), ten(a)), ten(a))
        to_right = F.pmod(s["r"] + F.pmod(_hash(key, salt, n, i, s["l"]), ten(n - a)), ten(n - a))
        return F.when(i % 2 == 0, F.struct(s["l"].alias("l"), to_right.alias("r"))) \
            .otherwise(F.struct(to_left.alias("l"), s["r"].alias("r")))

    end = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)
    left = F.when(a > 0, F.lpad(end["l"].cast("string"), a, "0")).otherwise("")
    return F.concat(left, F.lpad(end["r"].cast("string"), n - a, "0"))


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced one by one."""
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), lambda i: F.when(
        F.substr(shape, i, F.lit(1)).rlike("[0-9]"),
        F.substr(digits, F.length(F.regexp_replace(F.substr(shape, F.lit(1), i), "[^0-9]", "")), F.lit(1)))
        .otherwise(F.substr(shape, i, F.lit(1)))), "")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Sum of the digits before the check digit, doubled alternately from the right."""
    n = F.length(digits)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + _luhn_value(
        F.substr(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 0, 2).otherwise(1)))


def _luhn_value(d: Column) -> Column:
    return F.when(d > 9, d - 9).otherwise(d)


def _pick(names: str, n: Column) -> Column:
    return F.element_at(F.split(F.lit(names), " "), (F.pmod(n, F.lit(len(names.split()))) + 1).cast("int"))


def _syllables(script: str, n: int, hexes: Column) -> Column:
    """``n`` two-letter syllables chosen by four hex digits each."""
    at = lambda i: F.pmod(F.conv(F.substring(hexes, 4 * i + 1, 4), 16, 10).cast("int"), F.lit(len(script) // 2)) * 2 + 1
    return F.concat(*[F.substr(F.lit(script), at(i), F.lit(2)) for i in range(n)])


def _emails(e: DataFrame, key: str) -> DataFrame:
    """Syllables of the script, digit tails stay digits; one surrogate per host, top-level domain kept."""
    local, host = F.substring_index("canon", "@", 1), F.substring_index("canon", "@", -1)
    e = e.withColumn("tail", F.regexp_extract(local, r"[._-]?\d+$", 0)) \
        .withColumn("w", F.sha2(F.concat_ws("|", F.lit(key), F.lit("host"), host).cast("binary"), 256)) \
        .withColumn("name", F.when(local.rlike(r"\p{IsCyrillic}"), _syllables(CYRILLIC, 5, F.col("hex"))).otherwise(
            _syllables(LATIN, 5, F.col("hex")))) \
        .withColumn("digits", F.conv(F.substring("hex", 30, 14), 16, 10))
    digits = F.rpad("digits", 64, "7")
    return e.withColumn("s", F.concat("name", F.when(F.col("tail") != "", _refill(F.col("tail"), digits)).otherwise(""), F.lit("@"),
                                      _syllables(LATIN, 5, F.col("w")), F.lit(".example."), F.substring_index(host, ".", -1)))


def _ips(e: DataFrame, key: str) -> DataFrame:
    """Keyed permutation of two 16-bit halves."""
    part = lambda i: F.element_at(F.split("canon", r"\."), i).cast("long")
    wide = F.lit(65536).cast("long")
    turn = lambda s, i: F.when(i % 2 == 0, F.struct(s["l"].alias("l"), F.pmod(
        s["r"] + F.pmod(_hash(key, "ip", F.col("salt"), i, s["l"]), wide), wide).alias("r"))).otherwise(F.struct(F.pmod(
            s["l"] + F.pmod(_hash(key, "ip", F.col("salt"), i, s["r"]), wide), wide).alias("l"), s["r"].alias("r")))
    e = e.withColumn("m", F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(
        (part(1) * 256 + part(2)).alias("l"), (part(3) * 256 + part(4)).alias("r")), turn))
    return e.withColumn("s", F.concat_ws(".", *[f.cast("string") for h in ("l", "r") for f in (
        F.floor(F.col(f"m.{h}") / 256), F.pmod(F.col(f"m.{h}"), F.lit(256).cast("long")))]))


def _cards(e: DataFrame, key: str) -> DataFrame:
    """All but the check digit are permuted; the check digit keeps its distance from the right one."""
    n = F.length("canon")
    e = e.withColumn("head", F.substr("canon", F.lit(1), n - 1)) \
        .withColumn("new", _permute(F.col("head"), key, F.concat(F.lit("card"), "salt")))
    check = F.pmod(F.substr("canon", n, F.lit(1)).cast("int") + _luhn(F.col("head")) - _luhn(F.col("new")), F.lit(10))
    return e.withColumn("s", _refill(F.col("x"), F.concat("new", check.cast("string"))))


def _phones(e: DataFrame, key: str) -> DataFrame:
    """The country code stays."""
    e = e.withColumn("code", F.regexp_extract("x", r"^\+\d{1,3}(?=[\x20.(-])", 0)) \
        .withColumn("body", F.substr("x", F.length("code") + 1, F.length("x")))
    new = _permute(_digits(F.col("body")), key, F.concat(F.lit("phone"), "salt", "code"))
    return e.withColumn("s", F.concat("code", _refill(F.col("body"), new)))


def _ssns(e: DataFrame, key: str) -> DataFrame:
    return e.withColumn("s", _refill(F.col("x"), _permute(F.col("canon"), key, F.concat(F.lit("ssn"), "salt"))))


def _mod97(iban: Column) -> Column:
    """The number that an IBAN without separators stands for (letters count from 10, the first four
    characters go to the end), modulo 97; 1 for a valid one."""
    turned = F.concat(F.substr(iban, F.lit(5), F.length(iban)), F.substr(iban, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(turned)), lambda i: value(F.substr(turned, i, F.lit(1)))),
                       F.lit(0), lambda s, v: F.pmod(s * F.when(v > 9, 100).otherwise(10) + v, F.lit(97)))


def _ibans(e: DataFrame, key: str) -> DataFrame:
    """The country stays; digits after the check digits are permuted in pieces that a long can hold,
    letters are shifted by keyed amounts; the check digits keep their distance from the right ones,
    so that a valid IBAN stays valid."""
    body = F.substr("canon", F.lit(5), F.length("canon"))
    e = e.withColumn("digits", _digits(body)).withColumn("half", F.floor(F.length("digits") / 2).cast("int")) \
        .withColumn("left", F.substr("digits", F.lit(1), F.col("half"))) \
        .withColumn("right", F.substr("digits", F.col("half") + 1, F.length("digits"))) \
        .withColumn("left", F.when(F.length("left") > 0, _permute(F.col("left"), key, F.concat(F.lit("iban"), "salt", "right"))).otherwise("")) \
        .withColumn("right", F.when(F.length("right") > 0, _permute(F.col("right"), key, F.concat(F.lit("iban"), "salt", "left"))).otherwise(""))
    shift = lambda c, i: F.chr(F.pmod(F.ascii(c) - 65 + F.pmod(_hash(key, "iban", F.col("salt"), i, "digits"), F.lit(26)), F.lit(26)) + 65)
    new = _refill(body, F.concat("left", "right"))
    e = e.withColumn("body", F.array_join(F.transform(F.sequence(F.lit(1), F.length(new)), lambda i: F.when(
        F.substr(new, i, F.lit(1)).rlike("[A-Z]"), shift(F.substr(new, i, F.lit(1)), i)).otherwise(F.substr(new, i, F.lit(1)))), ""))
    right = lambda rest: F.lit(98) - _mod97(F.concat(F.substr("canon", F.lit(1), F.lit(2)), F.lit("00"), rest))
    e = e.withColumn("check", F.pmod(F.substr("canon", F.lit(3), F.lit(2)).cast("int") - right(body) + right(F.col("body")) - 2, F.lit(97)) + 2)
    e = e.withColumn("whole", F.concat(F.substr("canon", F.lit(1), F.lit(2)), F.lpad(F.col("check").cast("string"), 2, "0"), "body"))
    place = lambda i: F.length(F.regexp_replace(F.substr("x", F.lit(1), i), "[^A-Z0-9]", ""))
    return e.withColumn("s", F.array_join(F.transform(F.sequence(F.lit(1), F.length("x")), lambda i: F.when(
        F.substr("x", i, F.lit(1)).rlike("[A-Z0-9]"), F.substr("whole", place(i), F.lit(1))).otherwise(F.substr("x", i, F.lit(1)))), ""))


def _names(e: DataFrame, key: str) -> DataFrame:
    """Title kept, a first name of the title's gender and the script, a surname of the script's syllables."""
    e = e.withColumn("title", F.regexp_extract("x", r"^[\p{L}-]+\.?\x20", 0)) \
        .withColumn("rest", F.substr("x", F.length("title") + 1, F.length("x"))) \
        .withColumn("gender", F.when(F.col("title").rlike("^(?:Mrs|Miss|Ms|Frau|Mme|Madame|Señora|г-жа)"), 1)
                    .when(F.col("title").rlike("^(?:Dr|Prof)"), F.pmod(F.crc32(F.lower("rest").cast("binary")), F.lit(2)).cast("int")).otherwise(0)) \
        .withColumn("slav", F.col("rest").rlike(r"\p{IsCyrillic}")) \
        .withColumn("words", F.split(F.lower("rest"), " "))
    own = lambda i: F.sha2(F.concat_ws("|", F.lit(key), F.lit("name"), F.element_at("words", i), "salt").cast("binary"), 256)
    e = e.withColumn("last", own(-1)).withColumn("n", F.conv(F.substring(own(1), 1, 8), 16, 10).cast("long"))
    first = F.when(F.col("slav"), F.when(F.col("gender") == 1, _pick(FEMALE_CYRILLIC, F.col("n"))).otherwise(_pick(MALE_CYRILLIC, F.col("n")))) \
        .otherwise(F.when(F.col("gender") == 1, _pick(FEMALE, F.col("n"))).otherwise(_pick(MALE, F.col("n"))))
    last = F.initcap(F.when(F.col("slav"), _syllables(CYRILLIC, 4, F.col("last"))).otherwise(_syllables(LATIN, 4, F.col("last"))))
    return e.withColumn("s", F.concat("title", F.when(F.size("words") > 1, F.concat(first, F.lit(" "))).otherwise(""), last))


MAKERS = {"email": _emails, "ip": _ips, "ssn": _ssns, "card": _cards, "iban": _ibans, "name": _names, "phone": _phones}


def draw(entities: DataFrame, key: str) -> DataFrame:
    """(x, kind, canon, attempt) with the surrogate ``s`` of each spelling."""
    salted = entities.withColumn("salt", F.col("attempt").cast("string")) \
        .withColumn("hex", F.sha2(F.concat_ws("|", F.lit(key), "kind", "salt", "canon").cast("binary"), 256))
    parts = [make(salted.where(F.col("kind") == kind), key).select("x", "kind", "canon", "attempt", "s") for kind, make in MAKERS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def entities_of(text: Column) -> Column:
    """All entities of a text, in order; texts without one cost one scan."""
    return F.when(text.rlike(ENTITY), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def surrogates(found: DataFrame, key: str) -> DataFrame:
    """(x, s) of every spelling in the array column ``found``, without collisions."""
    spelled = cut(found.select(F.explode("found").alias("x")).groupBy("x").agg(F.lit(0).alias("attempt"))
                  .withColumn("kind", entity_type(F.col("x"))).withColumn("canon", canonical(F.col("x"))))
    real = spelled.select("kind", F.col("canon").alias("to")).distinct()
    state = spelled
    while True:
        drawn = cut(draw(state, key))
        made = drawn.select("kind", "canon", "attempt", canonical(F.col("s")).alias("to")).distinct()
        taken = made.join(real, ["kind", "to"], "left_semi").select("kind", "canon")
        # of the entities that share a surrogate, the first keeps it
        shared = made.groupBy("kind", "to").agg(F.countDistinct("canon").alias("n"), F.min(F.struct("attempt", "canon")).alias("first")).where("n > 1")
        twice = made.join(shared, ["kind", "to"]).where(F.col("canon") != F.col("first.canon")).select("kind", "canon")
        again = cut(taken.unionAll(twice).distinct().withColumn("more", F.lit(1)))
        if again.isEmpty():
            return drawn.select("x", "s")
        state = cut(state.join(again, ["kind", "canon"], "left")
                    .withColumn("attempt", F.col("attempt") + F.coalesce("more", F.lit(0))).drop("more"))


def replace_entities(docs: DataFrame, key: str, text_col: str = "text", types_col: str | None = None) -> DataFrame:
    """``docs`` with the entities of ``text_col`` replaced; ``types_col`` adds their types, in order."""
    text = F.col(text_col)
    has = F.coalesce(text.rlike(ENTITY), F.lit(False))
    h, k, made, own = (unused(docs, name) for name in ("h", "k", "new", "found"))
    # equal texts take part once; two hashes stand for a text
    seen = cut(docs.where(has).select(F.xxhash64(text_col).alias(h), F.xxhash64(F.lit("second"), text_col).alias(k),
                                      entities_of(text).alias("found")).dropDuplicates([h, k]))
    new = surrogates(seen, key)
    by_text = seen.select(h, k, F.explode(F.array_distinct("found")).alias("x")).join(new, "x") \
        .groupBy(h, k).agg(F.map_from_entries(F.collect_list(F.struct("x", "s"))).alias(made))
    touched = docs.where(has).withColumn(own, entities_of(text)) \
        .join(by_text, (F.xxhash64(text_col) == F.col(h)) & (F.xxhash64(F.lit("second"), text_col) == F.col(k)))
    gaps = F.split(text, ENTITY, -1)
    put = F.transform(own, lambda x: F.element_at(made, x))
    kinds = [F.transform(own, entity_type).alias(types_col)] if types_col else []
    joined = F.array_join(F.zip_with(gaps, put, lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), "")
    touched = touched.select(*[joined.alias(c) if c == text_col else F.col(c) for c in docs.columns], *kinds)
    rest = docs.where(~has)
    if types_col:
        rest = rest.withColumn(types_col, F.array().cast("array<string>"))
    return touched.unionByName(rest)


def pii_report(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with surrogates, n_entities and a count per type."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = replace_entities(named, key, types_col="__types")
    count = lambda kind: F.size(F.filter("__types", lambda t: t == kind)).cast("long")
    return out.select("doc_id", "text", F.size("__types").cast("long").alias("n_entities"),
                      *[count(k).alias(f"n_{k}") for k in TYPES])
