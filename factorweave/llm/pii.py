"""Personal data: detection and keyed surrogates, in built-in functions only.

One pattern finds the entities of a text. Each entity has a kind and a canonical form (lower case,
digits only, ...); its surrogate is a function of key, kind, canonical form and an attempt number:

- it keeps kind and format: separators, length, letter case, country code, issuer digit and Luhn
  validity of card numbers, gender, script, hyphens, apostrophes, particles and initials of names;
- the same entity has the same surrogate everywhere, in any spelling (coreference);
- different entities have different ones (distinctness). That is checked over the whole corpus: the
  distinct entities are grouped by surrogate, and those that share one, or hit an entity that really
  occurs, move to their next attempt until no conflict is left.

A name is found behind a title. Every other capitalised mention of one of its words in the same
document, before or after, is replaced by the same surrogate.

Surrogates of first attempts are computed in place. Only documents that hold a moved entity get
their attempts through a join with a table of those documents. It is written first, so Spark knows its size
and broadcasts it if small enough; otherwise all texts are shuffled.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, boxed, checkpointed, unboxed, written

KEY = "surrogates"
# Titles before names, by gender.
MALE = ("Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "Signor", "г-н", "господин", "κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Lady", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Doña", "Signora", "г-жа", "госпожа", "κυρία")
EITHER = ("Dr", "Prof", "Professor", "Doctor", "Docteur", "Doktor")
# Small words inside surnames.
PARTICLES = "van von der den de del della di da du la le el al bin ibn zu zum zur ter ten dos das y".split()
TITLES = rf"(?:{'|'.join(MALE + FEMALE + EITHER)})\.?(?: (?:{'|'.join(EITHER)})\.?)*"
#: A name's word: letters, joined by hyphens and apostrophes, without a possessive s.
NAME_WORD = r"\p{Lu}[\p{L}\p{M}]*(?:['’\-](?!s(?![\p{L}\p{M}]))\p{L}[\p{L}\p{M}]*)*"
INITIALS = r"(?:\p{Lu}\. ?)"

PATTERNS = {
    "email": r"[A-Za-z0-9_][A-Za-z0-9._%+\-]*@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "access_key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "hex_secret": r"(?<![A-Za-z0-9])[0-9a-f]{40}(?![A-Za-z0-9])",
    "card": r"(?<![\d.])(?:\d{13,19}|\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{1,7})(?!\d)",
    "ip": r"(?<![\d.])(?<![vV])(?<![vV]ersion )" + r"\.".join([r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"] * 4) + r"(?!\d|\.\d)",
    "ssn": r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
    "phone": r"(?<![\w+])(?:(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .\-]?\d{3,4}[ .\-]\d{3,4}|\+(?=(?:[ .\-/()]{0,2}\d){8,15}(?!\d))\d{1,3}(?:[ .\-/]?\(?\d{1,8}\)?){1,6})(?!\w)",
    "name": rf"(?<!\w){TITLES} {INITIALS}{{0,3}}(?:{NAME_WORD} {INITIALS}{{0,3}})?(?:(?:{'|'.join(PARTICLES)}) ){{0,3}}{NAME_WORD}",
}
#: Any entity. They all begin where no word goes on, which rules out most places at once.
ANY = rf"(?<![\w.%+\-])(?:{'|'.join(PATTERNS.values())})"
#: In documents with names: any entity, or a capitalised word that may be one of the names.
ANY_OR_WORD = rf"{ANY}|(?<![\p{{L}}\p{{M}}'’\-]){NAME_WORD}(?![\p{{L}}\p{{M}}])"
#: Pieces of text without which there is no entity; looking for them is cheap.
SIGNS = ("Mr", "Ms", "Miss", "Mister", "Madam", "Sir ", "Lady", "Herr", "Frau", "Mons", "Mme", "Mlle", "Señor", "Sr", "Don", "Doña", "Signor", "г-", "господин", "госпожа", "κύριος", "κυρία", "Dr", "Prof", "Do")
VOWELS = {"latin": "aeiou", "cyrillic": "аеиоу", "greek": "αεηου"}
CONSONANTS = {"latin": "bdfgklmnprstv", "cyrillic": "бвгдзклмнпрст", "greek": "βγδζκλμνπρστφ"}
ENDINGS = {"latin": ("o", "a", "is"), "cyrillic": ("ор", "на", "ин"), "greek": ("ος", "α", "ις")}
#: One-letter words that texts have without meaning a name: behind a title they are replaced, elsewhere left.
LETTER_WORDS = ("A", "E", "I", "O", "U", "Y", "À", "È", "И", "Я", "О", "У", "А", "К", "С", "В", "Η", "Ο")
#: A name of one-letter parts only, in lower case.
LETTERS_ONLY = r"^\p{L}\p{M}*(?:['’\-]\p{L}\p{M}*)*$"
#: Letters whose order a key turns, for initials.
ALPHABETS = (UPPER, "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once and written once in the plan."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def kind_of(found: Column) -> Column:
    """The first kind whose pattern the whole match fits; "word" for a capitalised word without a title."""
    out = F.when(title_of(found) != "", F.lit("name")).otherwise(F.lit("word"))
    for kind in reversed([k for k in PATTERNS if k != "name"]):
        out = F.when(F.regexp_extract(found, f"^(?:{PATTERNS[kind]})$", 0) != "", F.lit(kind)).otherwise(out)
    return out


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def title_of(found: Column) -> Column:
    return F.regexp_extract(found, rf"^{TITLES} ", 0)


def name_tokens(found: Column) -> Column:
    """What stands behind the title of a name: words, initials and particles."""
    return F.split(F.regexp_replace(found, rf"^{TITLES} ", ""), " ")


def is_initials(token: Column) -> Column:
    return token.rlike(r"^(?:\p{Lu}\.)+$")


def given_kind(found: Column) -> Column:
    male, female = (F.regexp_extract(found, rf"^(?:{'|'.join(t)})\.? ", 0) != "" for t in (MALE, FEMALE))
    return F.when(female, F.lit("given_f")).when(male, F.lit("given_m")).otherwise(F.lit("given"))


def name_entities(found: Column) -> Column:
    """The words of a titled name as array of (kind, canonical): the last is the surname, the others are given names."""
    words = F.filter(name_tokens(found), lambda t: t.rlike(r"^\p{Lu}") & ~is_initials(t))

    def entity(words: Column) -> Column:
        kind = lambda i: F.when(i == F.size(words) - 1, F.lit("surname")).otherwise(given_kind(found))
        return F.transform(words, lambda w, i: F.struct(kind(i).alias("kind"), F.lower(w).alias("canonical")))

    return let(words, entity)


def entities(found: Column, kind: Column) -> Column:
    """The entities of a match of a kind, as array of (kind, canonical): one, those of a name, or none for a word."""
    canonical = (
        F.when(kind == "email", F.lower(found))
        .when(kind == "phone", F.substring(digits(found), -10, 10))
        .when(kind.isin("card", "ssn"), digits(found))
        .when(kind == "iban", F.regexp_replace(found, " ", ""))
        .otherwise(found)
    )
    one = F.array(F.struct(kind.alias("kind"), canonical.alias("canonical")))
    return F.when(kind == "name", name_entities(found)).when(kind == "word", F.slice(one, 1, 0)).otherwise(one)


def stream(key: str, kind: Column, canonical: Column, attempt: Column) -> Column:
    """192 hexadecimal digits that key, entity and attempt decide."""
    part = lambda i: F.sha2(F.concat_ws("|", F.lit(key), kind, canonical, attempt.cast("string"), F.lit(str(i))), 256)
    return F.concat(part(0), part(1), part(2))


def byte(of: Column, place: Column) -> Column:
    """The place-th byte of a stream, from 0 and round again after 96."""
    return F.conv(F.substr(of, F.pmod(place, F.lit(96)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def pick(letters: str | Column, number: Column) -> Column:
    letters = F.lit(letters) if isinstance(letters, str) else letters
    return F.substr(letters, F.pmod(number, F.length(letters)) + 1, F.lit(1))


def shaped(text: Column, of: Column, skip: Column) -> Column:
    """text with its digits and ASCII letters replaced by others of their sort, after the first ``skip``."""

    def one(c: Column, i: Column) -> Column:
        sort = F.when(c.rlike("[0-9]"), F.lit("0123456789")).when(c.rlike("[a-z]"), F.lit(LOWER)).when(c.rlike("[A-Z]"), F.lit(UPPER))
        return F.coalesce(F.when(i >= skip, pick(sort, byte(of, i))), c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def named(kind: Column, canonical: Column, of: Column, attempt: Column) -> Column:
    """An invented name in lower case, of the entity's script and, for given names, gender: syllables and an ending.

    Hyphens, apostrophes and single letters beside longer parts stay; of a name of single letters the
    first becomes another letter. Later attempts are longer, so names never run out.
    """

    def by_script(values: dict[str, Column]) -> Column:
        return F.when(canonical.rlike(r"\p{IsCyrillic}"), values["cyrillic"]).when(canonical.rlike(r"\p{IsGreek}"), values["greek"]).otherwise(values["latin"])

    consonants, vowels = (by_script({k: F.lit(v) for k, v in x.items()}) for x in (CONSONANTS, VOWELS))
    ending = by_script({k: F.when(kind == "given_f", F.lit(f)).when(kind == "given_m", F.lit(m)).when(kind == "given", F.lit(n)).otherwise(F.lit("")) for k, (m, f, n) in ENDINGS.items()})
    places = F.sequence(F.lit(0), 6 + 2 * attempt)
    alone = canonical.rlike(LETTERS_ONLY)

    def part(old: Column, i: Column) -> Column:
        letters = F.transform(places, lambda j: pick(F.when(j % 2 == 0, consonants).otherwise(vowels), byte(of, j + 11 * i)))
        joint = F.regexp_extract(old, "['’\\-]$", 0)
        others = F.replace(F.concat(consonants, vowels), F.substring(old, 1, 1), F.lit(""))
        letter = F.transform(F.sequence(F.lit(0), attempt), lambda j: pick(F.when(j == 0, others).when(j % 2 == 1, vowels).otherwise(consonants), byte(of, j)))
        short = F.when(alone & (i == 0), F.concat(F.array_join(letter, ""), joint)).otherwise(old)
        return F.when(F.length(old) - F.length(joint) < 2, short).otherwise(F.concat(F.array_join(letters, ""), ending, joint))

    return F.array_join(F.transform(F.split(canonical, "(?<=['’\\-])"), part), "")


def cased(word: Column, value: Column) -> Column:
    """value, a name in lower case, with capitals as word has them: all, or at each part's begin."""
    parts = F.transform(F.split(value, "(?<=['’\\-])"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2))))
    return F.when((F.length(word) > 1) & (word == F.upper(word)), F.upper(value)).otherwise(F.array_join(parts, ""))


def turned(key: str, initials: Column) -> Column:
    """Initials under a permutation of each alphabet that the key decides and that leaves no letter in place."""
    step = int.from_bytes(hashlib.sha256(f"{key}|initials".encode()).digest()[:8], "big")
    cut = [1 + step % (len(a) - 1) for a in ALPHABETS]
    return F.translate(initials, "".join(ALPHABETS), "".join(a[n:] + a[:n] for a, n in zip(ALPHABETS, cut)))


def luhn_sum(number: Column) -> Column:
    """Luhn's sum of digits to which a check digit is still to be added on the right."""

    def add(acc: Column, c: Column) -> Column:
        d = c["d"].cast("int") * F.when(c["i"] % 2 == 0, 2).otherwise(1)
        return acc + d - F.when(d > 9, 9).otherwise(0)

    indexed = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.struct(d.alias("d"), i.alias("i")))
    return F.aggregate(indexed, F.lit(0), add)


def card(canonical: Column, of: Column) -> Column:
    """A number of that length and issuer digit, with a right check digit if canonical has one and a wrong one if not."""
    number = F.concat(F.substring(canonical, 1, 1), F.array_join(F.transform(F.sequence(F.lit(2), F.length(canonical) - 1), lambda i: pick("0123456789", byte(of, i))), ""))
    check = lambda n: F.pmod(10 - luhn_sum(n), F.lit(10))
    wrong = (check(F.substr(canonical, F.lit(1), F.length(canonical) - 1)).cast("string") != F.substring(canonical, -1, 1)).cast("int")
    return let(number, lambda n: F.concat(n, F.pmod(check(n) + wrong, F.lit(10)).cast("string")))


def surrogate(key: str, kind: Column, canonical: Column, attempt: Column) -> Column:
    """The canonical form of an entity's surrogate."""

    def of_stream(of: Column) -> Column:
        local, host = F.substring_index(canonical, "@", 1), F.substring_index(canonical, "@", -1)
        domain = F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), host), 256)
        skip = F.when(kind == "iban", 2).when(kind == "access_key", 4).when(kind.isin("ssn", "phone"), 1).otherwise(0)
        body = shaped(F.when(kind == "email", local).otherwise(canonical), of, skip)
        octets = F.transform(F.array(*[F.lit(i) for i in range(4)]), lambda i: (byte(of, i) % 254 + 1).cast("string"))
        return (
            F.when(kind == "card", card(canonical, of))
            .when(kind == "ip", F.array_join(octets, "."))
            .when(kind == "hex_secret", F.substring(of, 1, 40))
            .when(kind.isin("given", "given_f", "given_m", "surname"), named(kind, canonical, of, attempt))
            .otherwise(
                let(
                    body,
                    lambda b: F.when(kind == "email", F.concat(b, F.lit("@x"), F.substring(domain, 1, 10), F.lit(".example")))
                    .when(kind == "phone", F.concat(pick("23456789", byte(of, F.lit(0))), F.substr(b, F.lit(2))))
                    .when(kind == "ssn", F.concat(F.lit("9"), F.substr(b, F.lit(2))))
                    .otherwise(b),
                )
            )
        )

    return let(stream(key, kind, canonical, attempt), of_stream)


def formatted(found: Column, value: Column) -> Column:
    """value's characters put in the places of found's letters and digits, from the right; what is left over stays."""

    def one(c: Column, i: Column) -> Column:
        behind = F.length(F.regexp_replace(F.substr(found, i + 2), "[^0-9A-Za-z]", ""))
        return F.when(c.rlike("[0-9A-Za-z]") & (behind < F.length(value)), F.substr(value, F.length(value) - behind, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(found, ""), one), "")


def replacement(key: str, found: Column, names: Column, attempts: Column) -> Column:
    """What stands in a text for a match; names has the (kind, canonical) of the names of its document."""

    def of(e: Column) -> Column:
        return surrogate(key, e["kind"], e["canonical"], F.coalesce(F.try_element_at(attempts, F.concat_ws("|", e["kind"], e["canonical"])), F.lit(0)))

    def same_name(token: Column) -> Column:
        return F.get(F.filter(names, lambda e: e["canonical"] == F.lower(token)), F.lit(0))

    def name_token(token: Column) -> Column:
        word = let(same_name(token), lambda e: F.when(e.isNull(), token).otherwise(cased(token, of(e))))
        return F.when(is_initials(token), turned(key, token)).when(token.rlike(r"^\p{Lu}"), word).otherwise(token)

    def shown(kind: Column) -> Column:
        first = let(of(F.get(entities(found, kind), F.lit(0))), lambda v: (
            F.when(kind == "email", F.when(found == F.upper(found), F.upper(v)).otherwise(v)).when(kind.isin("card", "ssn", "phone", "iban"), formatted(found, v)).otherwise(v)
        ))
        whole = F.concat(title_of(found), F.array_join(F.transform(name_tokens(found), name_token), " "))
        return F.when(kind == "name", whole).when(kind == "word", F.when(found.isin(*LETTER_WORDS), found).otherwise(name_token(found))).otherwise(first)

    return let(kind_of(found), shown)


def likely(text: Column) -> Column:
    """Whether a text shows a sign of any entity."""
    out = text.rlike("[0-9@]")
    for sign in SIGNS:
        out = out | F.contains(text, F.lit(sign))
    return out


def matches(text: Column) -> Column:
    """All matches of a text, in order; null where the text is null or shows no sign of any."""
    return F.when(likely(text), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))


def document_key() -> Column:
    """Tells documents apart by id and text, as a 64-bit hash."""
    return F.xxhash64("doc_id", "text")


def occurrences(docs: DataFrame) -> DataFrame:
    """Rows (own, kind, canonical): the distinct entities of each document."""
    found = docs.select(document_key().alias("own"), F.explode(matches(F.col("text"))).alias("found"))
    told = found.withColumn("found_kind", kind_of(F.col("found")))
    return told.select("own", F.inline(entities(F.col("found"), F.col("found_kind")))).distinct()


def attempts_table(found: DataFrame, key: str, most: int = 50, make=surrogate) -> DataFrame:
    """Rows (kind, canonical, attempt) of the entities that cannot take their first surrogate.

    Of entities with one surrogate the smallest canonical form takes it; the others, and those whose
    surrogate is an entity that occurs or has been taken, try again. A round computes surrogates and
    groups by them for the entities that have none yet.
    """
    real = found.select("kind", F.lower("canonical").alias("value")).distinct()
    open_, taken = found.withColumn("attempt", F.lit(0)), real
    moved = found.sparkSession.createDataFrame([], found.select("kind", "canonical").schema).withColumn("attempt", F.lit(0))
    for _ in range(most):
        named_ = checkpointed(open_.withColumn("value", F.lower(make(key, F.col("kind"), F.col("canonical"), F.col("attempt")))))
        first = named_.groupBy("kind", "value").agg(F.min("canonical").alias("canonical"))
        won = checkpointed(first.join(taken, ["kind", "value"], "left_anti"))
        open_ = checkpointed(named_.join(won, ["kind", "value", "canonical"], "left_anti").select("kind", "canonical", (F.col("attempt") + 1).alias("attempt")))
        moved = moved.unionByName(named_.where("attempt > 0").join(won, ["kind", "value", "canonical"]).select(moved.columns))
        if open_.isEmpty():
            return moved
        taken = taken.unionByName(won.select("kind", "value"))
    raise RuntimeError(f"surrogates still collide after {most} attempts")


def replace_pii(docs: DataFrame, key: str = KEY) -> DataFrame:
    """docs with surrogates in text, all other columns as they are, and a column n_entities.

    n_entities counts the replaced places. A null text stays null with n_entities 0; an empty one stays
    empty. Repeated rows and ids are treated alike. An empty table gives an empty result. Other columns,
    whatever their names, are carried along; a column named n_entities is replaced. Names are found
    behind a title only; a text that mentions a person without any title keeps the name. A name of one
    letter is replaced by another letter, or more where letters run out; its mentions without a title
    are too, unless the letter is a word of its own (A, I, ...).
    """
    held = checkpointed(occurrences(docs))
    moved = checkpointed(attempts_table(held.select("kind", "canonical").distinct(), key))
    none = F.create_map().cast("map<string,int>")
    rows = boxed(docs, own=document_key(), text=F.col("text"), found=matches(F.col("text")))
    if moved.isEmpty():
        rows = rows.withColumn("attempts", none)
    else:
        entry = F.struct(F.concat_ws("|", "kind", "canonical"), "attempt")
        of_doc = held.join(moved, ["kind", "canonical"]).groupBy("own").agg(F.map_from_entries(F.collect_list(entry)).alias("told"))
        of_doc = written(of_doc, "attempts")  # its size is then known before Spark chooses the join, which else shuffles all texts
        rows = rows.join(of_doc, "own", "left").withColumn("attempts", F.coalesce("told", none))
    titled = F.filter("found", lambda m: title_of(m) != "")
    words = F.array_sort(F.array_distinct(F.flatten(F.transform(titled, name_entities))), lambda x, y: F.when(x["kind"] > y["kind"], -1).when(x["kind"] < y["kind"], 1).otherwise(0))
    rows = rows.withColumn("names", words)  # surnames first
    named_ = F.size("names") > 0
    rows = rows.withColumn("found", F.when(named_, F.regexp_extract_all("text", F.lit(ANY_OR_WORD), F.lit(0))).otherwise(F.col("found")))
    rows = rows.withColumn("new", F.transform("found", lambda m: replacement(key, m, F.col("names"), F.col("attempts"))))
    gaps = F.when(named_, F.split("text", ANY_OR_WORD, -1)).otherwise(F.split("text", ANY, -1))
    joined = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(F.col("new"), i), F.lit("")))), "")
    count = F.size(F.filter(F.arrays_zip("found", "new"), lambda x: x["found"] != x["new"]))
    rows = rows.withColumn("n", F.coalesce(F.when(F.size("found") > 0, count), F.lit(0)))
    return unboxed(rows, docs.columns, text=F.when(F.col("n") > 0, joined).otherwise(F.col("text")), n_entities=F.col("n"))


def surrogate_documents(docs: DataFrame, key: str = KEY) -> DataFrame:
    """docs with surrogates in text and n_chars set anew, in the columns of docs."""
    out = replace_pii(docs, key)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)
