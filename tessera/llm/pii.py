"""Personal data replaced by keyed surrogates, with DataFrame functions only.

Detected entities (mail addresses, phone numbers, IPv4 addresses, card numbers
with a right check digit, account numbers, access keys and secrets, names
after a form of address or from a known given name on) are replaced inside the
text.  Once a name is found, each of its words is replaced wherever it stands
in that document.  A surrogate keeps type, length, punctuation, letter case,
script, and vowels and consonants; forms of address stay, and given names are
exchanged within their gender.

A word's letters and digits are moved inside their alphabets by four keyed
Feistel rounds: each half is moved by a digest of the other one, so the work
grows with the length only, every step can be undone, distinct entities of a
type and shape have distinct surrogates, and one entity has the same one in
every document and format (phone, card and account numbers are enciphered
without their spacing, mail domains on their own).  Given names go round a
keyed cycle, so none stands for itself.

All the same each run checks what it did: the distinct pairs of entity and
surrogate are gathered, and if two entities share one, or one has two, all is
done again with the next key.  Only these pairs are shuffled.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import drop_columns_clashing, written

#: The setting that holds the key, and the value for tests and checks where it is unset.
KEY_SETTING, TEST_KEY = "spark.tessera.piiKey", "tessera"
#: Keys tried until a run has no collision.
KEYS = 8

#: Forms of address and given names by gender.
ADDRESSES = ("Mrs", "Mr", "Ms", "Miss", "Dr", "Herr", "Frau", "Monsieur", "Madame", "Mademoiselle", "Señora", "Señor", "Господин", "Госпожа")
FEMALE = ("Mary", "Anna", "Emma", "Julia", "Sophie", "Laura", "Marie", "Claire", "Carmen", "Lucía", "Elena", "Sarah", "Katharina", "Isabel", "Camille", "Hannah")
MALE = ("John", "Peter", "Paul", "Thomas", "Michael", "David", "Pierre", "Jean", "Carlos", "José", "Hans", "Karl", "Daniel", "Martin", "Louis", "Miguel")

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
# Groups that repeat without end are possessive: others recurse in Java's matcher, and a text of a few KB overflows its stack.
_NAME = r"\p{Lu}(?:\p{L}++|['’]\p{L}{2,}+)(?:[-'’]\p{L}{2,}+)*+"
_INITIALS = r"(?:\p{Lu}\.? )*+"
# Labels up to the last one that starts with two letters.
_DOMAIN = r"[A-Za-z0-9-]++(?:(?:\.(?![A-Za-z]{2})[A-Za-z0-9-]++)*+\.[A-Za-z]{2}[A-Za-z0-9-]*+)++"
#: Patterns by type, tried in this order at each place of the text.
PATTERNS = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@{_DOMAIN}",
    "ip": rf"(?<![0-9A-Za-z.])(?=[0-9])(?<!(?i:version|release|ver|rev|section|chapter)\.? )(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[0-9])(?![A-Za-z])",
    "phone": r"(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9A-Za-z])|(?<![0-9A-Za-z])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9A-Za-z])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "hex": r"(?<![A-Za-z0-9])(?=[a-f]*[0-9])[0-9a-f]{32,}(?![A-Za-z0-9])",
    "key": r"(?<![A-Za-z0-9])(?=[A-Z]*[0-9])[A-Z][A-Z0-9]{15,}(?![A-Za-z0-9])|(?<![A-Za-z0-9_+/-])(?=[A-Za-z0-9_][A-Za-z0-9_+/-]{11})(?=[A-Za-z_+/-]*[0-9])(?=[0-9_+/-]*[A-Za-z])(?<=(?i:token|key|secret|password|passwd|pwd|auth|bearer|credential)[\"']? {0,2}[=:][\"' ]{0,3})[A-Za-z0-9_+/-]{12,}",
    "name": rf"(?<!\p{{L}})(?=\p{{Lu}})(?:(?:{'|'.join(ADDRESSES)})\.? {_INITIALS}{_NAME}(?: {_INITIALS}{_NAME}){{0,2}}|(?:{'|'.join(FEMALE + MALE)})(?!\p{{L}})(?:-\p{{Lu}}\p{{L}}++)? {_INITIALS}{_NAME}(?: {_NAME})?)",
}
#: What the pattern of a key asks of the text before it; not to be asked of an entity alone.
_BEFORE_KEY = r"(?<=(?i:token|key|secret|password|passwd|pwd|auth|bearer|credential)[\"']? {0,2}[=:][\"' ]{0,3})"
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())

_ALPHABETS = (
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ",
    "àáâãäåæèéêëìíîïòóôõöøùúûü", "çñýÿß", "ÀÁÂÃÄÅÆÈÉÊËÌÍÎÏÒÓÔÕÖØÙÚÛÜ", "ÇÑÝ",
    "āăąēĕėęěĩīĭįōŏőœũūŭůűų", "ćĉċčďđĝğġģĥħĵķĺļľŀłńņňŋŕŗřśŝşšţťŧŵŷźżž", "ĀĂĄĒĔĖĘĚĨĪĬĮŌŎŐŒŨŪŬŮŰŲ", "ĆĈĊČĎĐĜĞĠĢĤĦĴĶĹĻĽĿŁŃŅŇŊŔŖŘŚŜŞŠŢŤŦŴŶŹŻŽ",
    "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕЁИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ",
    "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ",
)
_HEX = ("0123456789", "abcdef")


def _let(x: Column, of) -> Column:
    """``of(x)`` with ``x`` computed once."""
    return F.element_at(F.transform(F.array(x), of), 1)


def _letters(x: Column) -> Column:
    """The characters of a string as an array."""
    return F.split(x, "")


def _digest(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.lit(p) if isinstance(p, str) else p for p in parts]), 256)


def _moved(s: Column, other: Column, turn: Column, key: str, what: str, alphabets: tuple[str, ...]) -> Column:
    """``s`` with each character moved inside its alphabet by a keyed digest of ``other`` and the place."""
    every = "".join(alphabets)
    first = F.expr(f"array({', '.join(str(every.index(a)) for a in alphabets for _ in a)})")
    size = F.expr(f"array({', '.join(str(len(a)) for a in alphabets for _ in a)})")

    def of_blocks(blocks: Column) -> Column:
        def one(at: Column, i: Column) -> Column:
            by = F.crc32(F.substr(F.element_at(blocks, (F.floor(i / 16) + 1).cast("int")), (i % 16) * 4 + 1, F.lit(4)))
            there = F.element_at(first, at) + (at - 1 - F.element_at(first, at) + by) % F.element_at(size, at) + 1
            return F.when(at > 0, F.substr(F.lit(every), there.cast("int"), F.lit(1)))

        letters = F.transform(F.transform(_letters(s), lambda c: F.position(c, F.lit(every))), one)
        return F.array_join(F.zip_with(letters, _letters(s), lambda new, c: F.coalesce(new, c)), "")

    # Four hexadecimal digits of a digest for each character, sixteen characters for each digest.
    blocks = lambda k: F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / 16).cast("int")), lambda b: F.sha2(F.concat(k, b.cast("string")), 256))
    return F.when(F.length(s) > 0, _let(_digest(key, what, turn.cast("string"), F.length(other).cast("string"), F.length(s).cast("string"), other), lambda k: _let(blocks(k), of_blocks))).otherwise(s)


def enciphered(x: Column, key: str, what: str, alphabets: tuple[str, ...] = _ALPHABETS) -> Column:
    """A string of the same shape, by four keyed rounds that can be undone; other characters stay.

    A round moves one half by the other and lets them change places; the second half begins.
    """
    half = F.floor(F.length(x) / 2).cast("int")
    start = F.struct(F.substr(x, half + 1).alias("a"), F.substr(x, F.lit(1), half).alias("b"))
    turned = lambda h, turn: F.struct(h["b"].alias("a"), _moved(h["a"], h["b"], turn, key, what, alphabets).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(3)), start, turned, lambda h: F.concat(h["b"], h["a"]))


def _enciphered_word(word: str, key: str, what: str) -> str:
    """``enciphered`` of one word, on the driver."""
    from zlib import crc32

    a, b = word[: len(word) // 2], word[len(word) // 2 :]

    def moved(s: str, other: str, turn: int) -> str:
        k = hashlib.sha256("\x1f".join((key, what, str(turn), str(len(other)), str(len(s)), other)).encode()).hexdigest()
        out = []
        for i, c in enumerate(s):
            block = hashlib.sha256(f"{k}{i // 16}".encode()).hexdigest()
            letters = next((x for x in _ALPHABETS if c in x), c)
            out.append(letters[(letters.index(c) + crc32(block[i % 16 * 4 :][:4].encode())) % len(letters)])
        return "".join(out)

    for turn in range(4):
        a, b = (a, moved(b, a, turn)) if turn % 2 == 0 else (moved(a, b, turn), b)
    return a + b


def _filled(shape: Column, made: Column, of: str = "0-9") -> Column:
    """``shape`` with its characters of a class exchanged in turn."""
    return F.array_join(F.transform(_letters(shape), lambda c, i: F.when(c.rlike(f"^[{of}]$"), F.substr(made, F.length(F.regexp_replace(F.substr(shape, F.lit(1), i + 1), f"[^{of}]", "")), F.lit(1))).otherwise(c)), "")


def _cased(shape: Column, lower: Column) -> Column:
    """``lower`` in the letter case of ``shape``."""
    same = _let(F.lower(shape), lambda low: F.array_join(F.zip_with(_letters(lower), F.zip_with(_letters(shape), _letters(low), lambda a, b: a != b), lambda c, big: F.when(big, F.upper(c)).otherwise(c)), ""))
    return F.when(shape == F.lower(shape), lower).otherwise(same)


def _email(e: Column, key: str) -> Column:
    local, domain = F.substring_index(e, "@", 1), F.substring_index(e, "@", -1)
    name, top = F.regexp_extract(domain, r"^(.*)\.[^.]+$", 1), F.regexp_extract(domain, r"(\.[^.]+)$", 1)
    made = lambda part, what: _let(part, lambda p: _let(enciphered(F.lower(p), key, what), lambda new: _cased(p, new)))
    return F.concat(made(local, "local"), F.lit("@"), made(name, "domain"), top)


def _octets(e: Column, key: str) -> Column:
    def one(a: Column, turn: str) -> Column:
        return F.transform(a, lambda o, i: F.pmod(o.cast("long") + F.crc32(_digest(key, "ip", turn, F.array_join(F.slice(a, 1, i), "."))), F.lit(256)).cast("string"))

    return _let(F.split(e, r"\."), lambda a: _let(F.reverse(one(a, "a")), lambda b: F.array_join(F.reverse(one(b, "b")), ".")))


def _check_digit(body: Column) -> Column:
    """The Luhn check digit of a string of digits."""
    total = F.aggregate(F.transform(_letters(F.reverse(body)), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, F.lit(9)).otherwise(F.lit(0))).otherwise(c.cast("int"))), F.lit(0), lambda a, b: a + b)
    return F.pmod(-total, F.lit(10))


def _card(e: Column, key: str) -> Column:
    def of(digits: Column) -> Column:
        made = F.concat(F.substr(digits, F.lit(1), F.lit(1)), enciphered(F.substr(digits, F.lit(2), F.length(digits) - 2), key, "card"))
        return _let(_let(made, lambda new: F.concat(new, _check_digit(new).cast("string"))), lambda new: _filled(e, new))

    return _let(F.regexp_replace(e, "[^0-9]", ""), of)


def _is_card(e: Column) -> Column:
    return _let(F.regexp_replace(e, "[^0-9]", ""), lambda d: _check_digit(F.substr(d, F.lit(1), F.length(d) - 1)).cast("string") == F.substr(d, F.length(d), F.lit(1)))


def _phone(e: Column, key: str) -> Column:
    """The first digit stays, so that one number has one surrogate with and without marks of format."""
    made = lambda digits: F.concat(F.substr(digits, F.lit(1), F.lit(1)), enciphered(F.substr(digits, F.lit(2)), key, "phone"))
    return _let(_let(F.regexp_replace(e, "[^0-9]", ""), made), lambda new: _filled(e, new))


def _account(e: Column, key: str) -> Column:
    """The country stays."""
    made = lambda bare: F.concat(F.substr(bare, F.lit(1), F.lit(2)), enciphered(F.substr(bare, F.lit(3)), key, "account"))
    return _let(_let(F.replace(e, F.lit(" "), F.lit("")), made), lambda new: _filled(e, new, "A-Z0-9"))


def _key(e: Column, key: str) -> Column:
    """What does not start as a key identifier of that form is moved on until it does not either (a chance of one in 2,625 a step)."""

    def left(x: Column, steps: int) -> Column:
        if not steps:
            return x
        return _let(x, lambda y: F.when(y.startswith("AKIA"), left(enciphered(y, key, "key"), steps - 1)).otherwise(y))

    return F.when(e.startswith("AKIA"), F.concat(F.lit("AKIA"), enciphered(F.substr(e, F.lit(5)), key, "akia"))).otherwise(left(enciphered(e, key, "key"), 3))


def given_cycles(key: str) -> dict[str, str]:
    """For each given name the next of its gender in a keyed order."""
    out = {}
    for names in (FEMALE, MALE):
        order = sorted(names, key=lambda x: hmac.new(key.encode(), f"given\x1f{x}".encode(), "sha256").digest())
        out |= dict(zip(order, [*order[1:], order[0]], strict=True))
    return out


def _word(w: Column, key: str) -> Column:
    """The surrogate of a name's word: forms of address stay, given names go round, other words are enciphered."""
    # A word enciphered to a listed one goes on from there until it leaves the list, so that no two words meet.
    leaves = {x: _enciphered_word(x, key, "name") for x in (*ADDRESSES, *FEMALE, *MALE)}
    for x in leaves:
        for _ in leaves:  # a cycle of listed words only is never entered from outside
            leaves[x] = leaves.get(leaves[x], leaves[x])
    constant = lambda pairs: F.expr(f"map({', '.join(repr(x) for pair in pairs.items() for x in pair)})")
    fixed = constant(given_cycles(key) | {x: x for x in ADDRESSES} | {x + ".": x + "." for x in ADDRESSES})
    other = _let(enciphered(w, key, "name"), lambda new: F.coalesce(F.element_at(constant(leaves), new), new))
    return F.coalesce(F.element_at(fixed, w), other)


def _name(e: Column, key: str) -> Column:
    return F.array_join(F.transform(F.split(e, " "), lambda w: _word(w, key)), " ")


def type_of(e: Column) -> Column:
    """The type of an entity, the first whose pattern fits all of it (what stands around is no longer known); empty for digits that are no card's."""
    out = F.lit("key")
    for name, pattern in reversed(PATTERNS.items()):
        said = F.when(_is_card(e), F.lit(name)).otherwise(F.lit("")) if name == "card" else F.lit(name)
        out = F.when(e.rlike(rf"^(?:{pattern.replace(_BEFORE_KEY, '')})$"), said).otherwise(out)
    return out


def surrogate(e: Column, key: str, kind: Column | None = None) -> Column:
    """The surrogate of an entity (itself where it has no type)."""
    if kind is None:
        return _let(F.struct(e.alias("e"), type_of(e).alias("t")), lambda x: surrogate(x["e"], key, x["t"]))
    return (
        F.when(kind == "", e).when(kind == "email", _email(e, key)).when(kind == "ip", _octets(e, key)).when(kind == "phone", _phone(e, key)).when(kind == "card", _card(e, key))
        .when(kind == "account", _account(e, key)).when(kind == "name", _name(e, key)).when(kind == "hex", enciphered(e, key, "hex", _HEX)).otherwise(_key(e, key))
    )


def entities(text: Column, pattern: Column | None = None) -> Column:
    """All places of the patterns in a text in order, repeats included."""
    return F.regexp_extract_all(text, F.lit(PATTERN) if pattern is None else pattern, F.lit(0))


def _words_of_names(found: Column) -> Column:
    """The words of the names among some entities, longest first; no forms of address, no initials."""
    names = F.filter(F.array_distinct(found), lambda e: type_of(e) == "name")
    forms = F.array(*[F.lit(x + dot) for x in ADDRESSES for dot in ("", ".")])
    each = F.array_except(F.flatten(F.transform(names, lambda e: F.split(e, " "))), forms)
    sized = F.transform(F.filter(each, lambda w: w.rlike(rf"^{_NAME}$")), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))
    return F.transform(F.array_sort(sized), lambda x: x["w"])


def _replaced(docs: DataFrame, names: list[str], text_col: str, key: str) -> DataFrame:
    """Columns ``_0`` and so on of ``names``, the new ``text`` and ``pairs`` of (type, entity, surrogate), one for each place."""
    text, none = F.col("text"), F.array().cast("array<string>")
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)], F.col(f"`{text_col}`").alias("text")).withColumn("found", entities(text))
    rows = rows.withColumn("words", F.when(F.exists("found", lambda e: e.rlike(r"^\p{Lu}")), _words_of_names(F.col("found"))).otherwise(none))
    some = F.size("words") > 0
    # The words are letters, hyphens and apostrophes only, so they need no quoting.
    pattern = F.when(some, F.concat(F.lit(PATTERN + r"|(?<!\p{L})(?:"), F.array_join("words", "|"), F.lit(r")(?!\p{L})"))).otherwise(F.lit(PATTERN))
    rows = rows.withColumn("pattern", pattern).withColumn("found", F.when(some, entities(text, F.col("pattern"))).otherwise(F.col("found")))
    kind = lambda e: F.when(F.array_contains("words", e), F.lit("name")).otherwise(type_of(e))
    pair = lambda x: F.struct(x["t"].alias("type"), x["e"].alias("entity"), surrogate(x["e"], key, x["t"]).alias("surrogate"))
    rows = rows.withColumn("pairs", F.when(F.size("found") > 0, F.transform(F.transform("found", lambda e: F.struct(e.alias("e"), kind(e).alias("t"))), pair)))
    pieces = F.zip_with(F.split(text, F.col("pattern"), -1), F.transform("pairs", lambda p: p["surrogate"]), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return rows.withColumn("text", F.when(F.exists("pairs", lambda p: p["type"] != ""), F.array_join(pieces, "")).otherwise(text)).select(*[f"_{i}" for i in range(len(names))], "text", F.filter("pairs", lambda p: p["type"] != "").alias("pairs"))


def canonical(e: Column, kind: Column) -> Column:
    """What two mentions of one entity share: lower case for mail, digits for phone and card numbers, no spaces for accounts."""
    return F.when(kind == "email", F.lower(e)).when(kind.isin("phone", "card"), F.regexp_replace(e, "[^0-9]", "")).when(kind == "account", F.replace(e, F.lit(" "), F.lit(""))).otherwise(e)


def collisions(pairs: DataFrame) -> DataFrame:
    """Among ``(type, entity, surrogate)`` the surrogates of several entities and entities with several surrogates: ``(type, value, n)``; empty if all is well."""
    kind = F.col("type")
    each = pairs.distinct().select("type", canonical(F.col("entity"), kind).alias("a"), canonical(F.col("surrogate"), kind).alias("b")).distinct()
    one = each.groupBy("type", F.col("b").alias("value")).agg(F.count("*").alias("n"))
    other = each.groupBy("type", F.col("a").alias("value")).agg(F.count("*").alias("n"))
    return one.union(other).where("n > 1")


def pii_key(spark: SparkSession) -> str:
    """The key that the session names; the test key where it names none."""
    return spark.conf.get(KEY_SETTING, TEST_KEY)


def replace_personal_data(docs: DataFrame, key: str, text_col: str = "text", counts: bool = True) -> DataFrame:
    """``docs`` with surrogates in the text and, if ``counts``, n_entities, n_distinct and entity_types.

    entity_types are the distinct types, sorted, comma-joined.  A null text
    stays null and has no entities; a text without entities is not changed.
    Repeated rows get the same result; an empty table gives an empty one.  The
    result is written to the shared folder, and the pairs of all documents are
    checked for collisions.  Columns with added names give way; others may
    have any name.
    """
    added = ("n_entities", "n_distinct", "entity_types")
    names = [c for c in (drop_columns_clashing(docs, *added) if counts else docs).columns if c != text_col]
    order = [c for c in docs.columns if c == text_col or c in names]
    for turn in range(KEYS):
        rows = written(_replaced(docs, names, text_col, key if not turn else f"{key}\x1f{turn}"))
        if collisions(rows.select(F.explode("pairs").alias("p")).select("p.*")).isEmpty():
            break
    else:
        raise RuntimeError(f"surrogates collide under {KEYS} keys")
    n = F.coalesce(F.size("pairs"), F.lit(0))
    none = F.coalesce(n <= 0, F.lit(True))
    more = [
        F.when(none, F.lit(0)).otherwise(n).cast("long").alias("n_entities"),
        F.when(none, F.lit(0)).otherwise(F.size(F.array_distinct(F.transform("pairs", lambda p: p["entity"])))).cast("long").alias("n_distinct"),
        F.when(none, F.lit("")).otherwise(F.array_join(F.array_sort(F.array_distinct(F.transform("pairs", lambda p: p["type"]))), ",")).alias("entity_types"),
    ]
    kept = [(F.col("text") if c == text_col else F.col(f"_{names.index(c)}")).alias(c) for c in order]
    return rows.select(*kept, *(more if counts else []))


def surrogate_collisions(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """What ``replace_personal_data`` with this key alone would have to redo: ``collisions`` of all pairs of a corpus."""
    return collisions(_replaced(docs, [], text_col, key).select(F.explode("pairs").alias("p")).select("p.*"))
