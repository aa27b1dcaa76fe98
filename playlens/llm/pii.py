"""Personal data and secrets replaced by keyed surrogates, in SQL functions only.

Detected entities (e-mail and IP addresses, phone, card and social-security
numbers, access keys, secrets after a naming word, person names) are replaced
where they stand. A surrogate is a keyed permutation of its entity: the
characters are cut into two halves, and in four Feistel rounds every character
of one half moves within its own alphabet by an amount hashed from the key, the
type and the other half. Class and place of every character stay, so format,
script and case stay; the map can be inverted by whoever knows the key rounds,
hence two entities never share a surrogate, and one entity has the same surrogate
everywhere, with no table to join. Given names move within the list of their
gender and script. Card numbers keep their network digit and a right check digit
(numbers without one are no cards and stay), phone numbers their country code, addresses their top domain.

:func:`check` still counts, over a whole corpus, entities, surrogates shared by two
entities and entities left unchanged; :func:`masked` draws anew where two are shared.

Cases: null text stays null, empty text stays empty, a text without entities stays
as it is to the byte; repeated rows are masked alike; an empty table gives an empty
result; columns beside the text are kept as they are. Texts are read whole.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playlens.llm.common import stage

# Common given names by script and gender.
GIVEN = {
    ("latin", "f"): ("Alice", "Anna", "Barbara", "Carmen", "Charlotte", "Claire", "Elizabeth", "Emma", "Hannah",
                     "Ingrid", "Isabel", "Jennifer", "Julia", "Laura", "Linda", "Lucia", "Maria", "Marie", "Mary",
                     "Patricia", "Sarah", "Sofia", "Susan", "Ursula"),
    ("latin", "m"): ("Antonio", "Carlos", "Charles", "Daniel", "David", "Hans", "James", "Jean", "John", "José",
                     "Juan", "Karl", "Klaus", "Louis", "Michael", "Miguel", "Paul", "Peter", "Pierre", "Richard",
                     "Robert", "Stefan", "Thomas", "William"),
    ("cyrillic", "f"): ("Анна", "Вера", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Светлана", "Татьяна", "Юлия"),
    ("cyrillic", "m"): ("Александр", "Алексей", "Андрей", "Дмитрий", "Иван", "Михаил", "Николай", "Павел", "Сергей", "Юрий"),
}
# Titles that announce a surname.
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora")

#: Alphabets within which a character may move; others stay as they are.
WORD = ("aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "0123456789",
        "áéíóú", "ÁÉÍÓÚ", "àèìòù", "äëïöü", "ÄËÏÖÜ", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ",
        "АЕИОУЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ")
SECRET = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ")
DIGITS = ("0123456789",)
#: Draws before entities that still share a surrogate are an error.
DRAWS = 8

OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d?\d)"
NAME = r"\p{Lu}\p{Ll}+"
CARD = (r"(?:[2-6]\d{3}(?:\d{12}|(?: \d{4}){3}|(?:-\d{4}){3})"
        r"|3[47]\d{2}(?:\d{11}| \d{6} \d{5}|-\d{6}-\d{5}))")
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "ip": rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)",
    "card": rf"(?<![\d-]){CARD}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])(?:\+?1[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<![\d+])\+[1-9]\d{8,14}(?!\d)",
    "key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z0-9_/+-]{16})(?<=(?i:token|secret|passwd|password|api_key|apikey|access_key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?)[A-Za-z0-9_/+-]{16,}",
    "person": rf"(?<!\p{{L}})(?=\p{{Lu}})(?:(?:{'|'.join(n for g in GIVEN.values() for n in g)})|(?:{'|'.join(TITLES)})\.?) {NAME}(?!\p{{L}})",
}
ANY = "|".join(PATTERNS.values())


def may_hold(text: Column) -> Column:
    """Whether any pattern can match at all: cheap tests where most texts end."""
    return (text.rlike("[@0-9:=]") | text.contains("AKIA") | text.contains("ASIA")
            | text.rlike(PATTERNS["person"]))


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _chars(s: Column) -> Column:
    return F.when(F.char_length(s) > 0, F.transform(F.sequence(F.lit(1), F.char_length(s)), lambda i: F.substring(s, i, F.lit(1)))).otherwise(F.array().cast("array<string>"))


def _moved(c: Column, by: Column, alphabets: tuple) -> Column:
    out = None
    for a in alphabets:
        at = F.position(c, F.lit(a))
        to = F.substring(F.lit(a), F.pmod(at - 1 + by, F.lit(len(a))) + 1, F.lit(1))
        out = F.when(at > 0, to) if out is None else out.when(at > 0, to)
    return out.otherwise(c)


def permuted(s: Column, secret: str, kind: str, alphabets: tuple) -> Column:
    """A string under the keyed permutation that keeps every character's alphabet."""

    def one(state: Column, r: Column) -> Column:
        left, right = state["l"], state["r"]
        digest = F.sha2(F.concat(F.lit(f"{secret}|{kind}|"), r.cast("string"), F.lit("|"), F.lower(right)), 256)

        def moved_by(d: Column) -> Column:
            def move(c: Column, i: Column) -> Column:
                by = F.conv(F.substring(d, F.pmod(i * 4, F.lit(60)) + 1, F.lit(4)), 16, 10).cast("int")
                return _moved(c, by, alphabets)

            return F.array_join(F.transform(_chars(left), move), "")

        return F.struct(right.alias("l"), let(digest, moved_by).alias("r"))

    def rounds(x: Column) -> Column:
        half = F.floor(F.char_length(x) / 2).cast("int")
        zero = F.struct(F.substring(x, F.lit(1), half).alias("l"), F.substring(x, half + 1, F.char_length(x)).alias("r"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(4)), zero, one, lambda done: F.concat(done["l"], done["r"]))

    return let(s, rounds)


def _refill(s: Column, digits: Column) -> Column:
    """``s`` with its digits replaced, in order, by those of ``digits``."""
    def filled(new: Column) -> Column:
        def put(c: Column, i: Column) -> Column:
            at = F.char_length(F.regexp_replace(F.substring(s, F.lit(1), i + 1), r"[^0-9]", ""))
            return F.when(c.rlike("[0-9]"), F.substring(new, at, F.lit(1))).otherwise(c)

        return F.array_join(F.transform(_chars(s), put), "")

    return let(digits, filled)


def _only_digits(s: Column) -> Column:
    return F.regexp_replace(s, r"[^0-9]", "")


def _luhn(payload: Column) -> Column:
    """The check digit that a payload of digits asks for."""
    n = F.char_length(payload)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(payload, i, F.lit(1)).cast("int") * F.when(F.pmod(n - i, F.lit(2)) == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.pmod(F.lit(10) - F.pmod(F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add), F.lit(10)), F.lit(10))


def luhn_valid(digits: Column) -> Column:
    """Whether the last digit is the check digit of the others."""
    n = F.char_length(digits)
    return _luhn(F.substring(digits, F.lit(1), n - 1)) == F.substring(digits, n, F.lit(1)).cast("int")


def _email(s: Column, secret: str) -> Column:
    body = F.regexp_extract(s, r"^(.*)\.[A-Za-z]+$", 1)
    return F.concat(permuted(body, secret, "email", WORD), F.substring(s, F.char_length(body) + 1, F.char_length(s)))


def _ip(s: Column, secret: str) -> Column:
    """Two halves of two octets under the same rounds. An octet with leading zeros moves
    among those of its length, so two spellings never share a surrogate."""

    def of_octets(o: Column) -> Column:
        octet = [F.get(o, F.lit(i)) for i in range(4)]
        padded = [x.rlike("^0[0-9]") for x in octet]
        size = [F.when(~p, 256).when(F.char_length(x) == 2, 10).otherwise(100) for x, p in zip(octet, padded)]
        value = [x.cast("int") for x in octet]

        def one(state: Column, r: Column) -> Column:
            digest = F.sha2(F.concat(F.lit(f"{secret}|ip|"), r.cast("string"), F.lit("|"), state["r"].cast("string")), 256)
            by = F.conv(F.substring(digest, 1, 4), 16, 10).cast("int")
            moved = F.pmod(state["l"] + by, state["m"])
            return F.struct(state["r"].alias("l"), state["n"].alias("m"), moved.alias("r"), state["m"].alias("n"))

        def spelled(done: Column) -> Column:
            parts = [F.floor(done["l"] / size[1]), F.pmod(done["l"], size[1]), F.floor(done["r"] / size[3]), F.pmod(done["r"], size[3])]
            return F.concat_ws(".", *(F.when(p, F.lpad(x.cast("string"), F.char_length(of), "0")).otherwise(x.cast("string"))
                                      for x, p, of in zip(parts, padded, octet)))

        zero = F.struct((value[0] * size[1] + value[1]).alias("l"), (size[0] * size[1]).alias("m"),
                        (value[2] * size[3] + value[3]).alias("r"), (size[2] * size[3]).alias("n"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(4)), zero, one, spelled)

    return let(F.split(s, r"\."), of_octets)


def _card(s: Column, secret: str) -> Column:
    def of_digits(d: Column) -> Column:
        n = F.char_length(d)
        payload = F.substring(d, F.lit(1), n - 1)
        moved = F.concat(F.substring(d, 1, 1), permuted(F.substring(d, F.lit(2), n - 2), secret, "card", DIGITS))
        off = F.substring(d, n, F.lit(1)).cast("int") - _luhn(payload)
        return let(moved, lambda m: F.concat(m, F.pmod(_luhn(m) + off, F.lit(10)).cast("string")))

    return _refill(s, let(_only_digits(s), of_digits))


def _phone(s: Column, secret: str) -> Column:
    """Country code and the first digits of area and exchange stay."""
    def of_digits(d: Column) -> Column:
        head = F.when(F.char_length(d) >= 10, F.char_length(d) - 10).otherwise(0)
        nat = F.substring(d, head + 1, F.lit(10))
        rest = permuted(F.concat(F.substring(nat, 2, 2), F.substring(nat, 5, 6)), secret, "phone", DIGITS)
        return let(rest, lambda x: F.concat(F.substring(d, F.lit(1), head), F.substring(nat, 1, 1), F.substring(x, 1, 2),
                                            F.substring(nat, 4, 1), F.substring(x, 3, 6)))

    return _refill(s, let(_only_digits(s), of_digits))


def given_names(secret: str) -> dict:
    """Each given name with the next one of its gender and script in keyed order."""
    out = {}
    for names in GIVEN.values():
        order = sorted(names, key=lambda n: hashlib.sha256(f"{secret}|given|{n}".encode()).digest())
        out |= dict(zip(order, order[1:] + order[:1]))
    return out


def _person(s: Column, secret: str) -> Column:
    first, last = F.substring_index(s, " ", 1), F.substring_index(s, " ", -1)
    names = F.create_map(*(F.lit(x) for pair in given_names(secret).items() for x in pair))
    return F.concat(F.coalesce(F.try_element_at(names, first), first), F.lit(" "), permuted(last, secret, "surname", WORD))


def kind_of(m: Column) -> Column:
    """The type of a match; null for numbers like a card's without a right check digit."""
    return (F.when(m.contains("@"), "email").when(m.rlike(rf"^(?:{OCTET}\.){{3}}{OCTET}$"), "ip")
            .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn").when(m.rlike(f"^{CARD}$"), F.when(luhn_valid(_only_digits(m)), "card"))
            .when(m.rlike(r"^(?:AKIA|ASIA)[A-Z0-9]{16}$"), "key").when(m.rlike(r"^[+(]?\d[\d ().-]+$") & ~m.rlike(r"^\d+$"), "phone")
            .when(m.rlike(rf"^{NAME}\.? {NAME}$"), "person").otherwise("secret"))


def surrogate(kind: Column, m: Column, secret: str) -> Column:
    return (F.when(kind.isNull(), m).when(kind == "email", _email(m, secret)).when(kind == "ip", _ip(m, secret))
            .when(kind == "card", _card(m, secret)).when(kind == "phone", _phone(m, secret))
            .when(kind == "ssn", _refill(m, permuted(_only_digits(m), secret, "ssn", DIGITS)))
            .when(kind == "key", F.concat(F.substring(m, 1, 4), permuted(F.substring(m, 5, 16), secret, "key", SECRET)))
            .when(kind == "person", _person(m, secret)).otherwise(permuted(m, secret, "secret", SECRET)))


def entities(text: Column, secret: str) -> Column:
    """array<struct<kind, entity, surrogate>> of all matches in order of place; empty
    for null. Matches that are no entity have no kind and stay as they are."""
    found = F.when(may_hold(text), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    none = F.array().cast("array<struct<kind:string,entity:string,surrogate:string>>")

    def one(m: Column) -> Column:
        return let(kind_of(m), lambda kind: F.struct(
            kind.alias("kind"), m.alias("entity"), surrogate(kind, m, secret).alias("surrogate")))

    return F.coalesce(F.transform(found, one), none)


def mask(docs: DataFrame, secret: str, found: str = "pii_entities", redrawn: str | None = None) -> DataFrame:
    """``docs`` with ``text`` masked, and the entities in a column ``found`` (which
    replaces one of that name). A column ``redrawn`` (map of kind|entity to surrogate,
    or null) goes before the usual surrogates and is dropped."""
    matches, parts = f"{found}_matches", f"{found}_parts"
    rows = docs.withColumn(matches, entities(F.col("text"), secret))
    if redrawn:
        rows = rows.withColumn(matches, F.transform(matches, lambda e: F.struct(e["kind"], e["entity"], F.coalesce(
            F.try_element_at(redrawn, F.concat_ws("|", e["kind"], e["entity"])), e["surrogate"]).alias("surrogate")))).drop(redrawn)
    rows = rows.withColumn(found, F.filter(matches, lambda e: e["kind"].isNotNull()))
    rows = rows.withColumn(parts, F.split(F.when(F.size(found) > 0, F.col("text")), ANY, -1))
    filled = F.transform(matches, lambda e, i: F.concat(e["surrogate"], F.get(parts, i + 1)))
    new = F.concat(F.get(parts, F.lit(0)), F.array_join(filled, ""))
    return rows.withColumn("text", F.when(F.size(found) > 0, new).otherwise(F.col("text"))).drop(matches, parts)


def check(masked_docs: DataFrame, found: str = "pii_entities") -> DataFrame:
    """Per kind: entities, distinct surrogates, shared (surrogates of two entities), unchanged."""
    each = masked_docs.select(F.explode(found).alias("e")).select("e.*").distinct()
    return (each.groupBy("kind", "surrogate").agg(F.count("*").alias("n"), F.count_if(F.col("entity") == F.col("surrogate")).alias("same"))
            .groupBy("kind").agg(F.sum("n").alias("entities"), F.count("*").alias("surrogates"),
                                 F.count_if(F.col("n") > 1).alias("shared"), F.sum("same").alias("unchanged")))


def redraw(each: DataFrame, secret: str) -> DataFrame:
    """New surrogates (kind, entity, fresh) for entities that share one: the smallest
    entity keeps it, the others draw with a further key until none is shared.

    ``each`` has the distinct (kind, entity, surrogate). Raises if ``DRAWS`` draws do not do.
    """
    now = stage(each.withColumn("fresh", F.col("surrogate")), "draws")
    for draw in range(1, DRAWS + 1):
        least = now.groupBy("kind", "fresh").agg(F.min("entity").alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n")
        again = surrogate(F.col("kind"), F.col("entity"), f"{secret}|draw{draw}")
        now = stage(now.join(least, ["kind", "fresh"], "left")
                    .withColumn("fresh", F.when(F.col("entity") != F.col("owner"), again).otherwise(F.col("fresh"))).drop("owner"), "draws")
        if now.groupBy("kind", "fresh").count().where("count > 1").isEmpty():
            return now.where("fresh != surrogate").select("kind", "entity", "fresh")
    raise ValueError(f"entities share surrogates after {DRAWS} draws")


def masked(docs: DataFrame, secret: str, found: str = "pii_entities") -> DataFrame:
    """:func:`mask`, written to a stage table and checked. If entities share a surrogate,
    all but one of them get another, in every text that holds them (see :func:`redraw`)."""
    done = stage(mask(docs, secret, found), "masked")
    if check(done, found).where("shared > 0").isEmpty():
        return done
    each = done.select(F.explode(found).alias("e")).select("e.*").distinct()
    fresh = redraw(each, secret)
    key, fixes = f"{found}_key", f"{found}_fixes"
    held = (docs.select(F.sha2("text", 256).alias(key), F.explode(entities(F.col("text"), secret)).alias("e"))
            .select(key, "e.kind", "e.entity").distinct().join(fresh, ["kind", "entity"]))
    maps = held.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "entity"), "fresh"))).alias(fixes))
    rows = docs.withColumn(key, F.sha2("text", 256)).join(maps, key, "left").drop(key)
    return stage(mask(rows, secret, found, fixes), "masked").select(*done.columns)
