"""PII: detected entities get keyed surrogates of the same kind and format; DataFrame functions only.

One pattern finds e-mail addresses, phone, card (valid check digit), social
security and account (IBAN, written together or in fours) numbers, IP addresses,
secrets after a telling word, access keys, and names: after a title, after a
common given name, or after words that introduce one.

Mentions are brought to entities in a canonical form (case, separators and
country codes aside; a name is one entity for each of its words, so that a
person keeps the family name whether or not a title or given name stands before
it). All mentions of an entity get one surrogate, drawn from HMAC-SHA-512 of
kind, canonical form and attempt under a secret key; entities whose surrogate
another entity has or is are drawn again until all are distinct and new.
Mentions are then written in their own format: separators, capitals, country
codes, titles; names keep script and gender; card and account numbers keep
valid check digits.

A text is matched once for its mentions, which are kept in order with a digest
of the text, and split once when it is put together again.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcastable, discard, fresh, written
from .decontam import let

#: Tables of mentions and of texts with mentions are broadcast up to so many rows and 64 MB.
BROADCAST_ROWS = 200_000
#: So many draws in a row that leave as many entities without a surrogate as before end a run with an error.
PATIENCE = 40

# Titles by the gender they tell.
MALE = ["Mr", "Herr", "Monsieur", "Señor", "Господин", "Κύριος"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Госпожа", "Κυρία"]
NEUTRAL = ["Dr", "Prof"]
# Common given names by gender.
GIVEN_MALE = (
    "Adam Alexander Andrew Anthony Antonio Benjamin Carlos Charles Christopher Daniel David Edward Felix Francisco Frank George "
    "Hans Henry Jack Jacques James Javier Jean Johann John Jonas José Joseph Juan Karl Klaus Kevin Louis Lukas Luis Manuel Mark "
    "Martin Matthew Max Michael Miguel Nicholas Oliver Pablo Paul Pedro Peter Philip Pierre Richard Robert Samuel Stefan Stephen "
    "Steven Thomas Tobias William Иван Дмитрий Сергей Алексей Γιώργος Νίκος"
).split()
GIVEN_FEMALE = (
    "Alice Amelia Ana Andrea Angela Anna Barbara Camille Carmen Caroline Catherine Charlotte Chloé Christine Claudia Clara Diana "
    "Elena Elizabeth Emily Emma Eva Hannah Heidi Helen Isabel Jane Jennifer Jessica Julia Karen Katharina Laura Linda Lisa Lucía "
    "Margaret Maria María Marie Mary Monika Nancy Nicole Olivia Patricia Petra Rachel Rebecca Sabine Sandra Sarah Sofia Sophie "
    "Susan Ursula Victoria Анна Мария Елена Ольга Ελένη Μαρία"
).split()
# Words that introduce a name, and capitalised words that are none.
CONTEXTS = ["my name is ", "name: ", "contact ", "signed, ", "regards, ", "dear "]
NO_NAMES = "Sir|Madam|All|Team|Friends|Customer|Sirs|Us|The|Our|Your|Support"
# Particles of family names, and words that tell a secret.
PARTICLES = "van von der den dem de del della di da dos du la le ten ter zu zum bin al af av".split()
TELLING = "token|secret|password|passwd|passphrase|pwd|api[_-]?key|access[_-]?key|bearer"
# Syllables and endings of made-up names by script.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga ge ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve vo".split(),
    "cyrillic": "ба бе бо да де до га ка ко ла ле ло ма ме мо на не но па пе ра ре ро са се со та те то ва ве во".split(),
    "greek": "βα βε βο δα δε δο γα κα κο λα λε λο μα με μο να νε νο πα πε ρα ρε ρο σα σε σο τα τε το".split(),
}
ENDINGS = {
    "latin": {"m": ["rin", "son", "nor"], "f": ["lina", "rita", "nela"], "n": ["ris", "len", "kim"]},
    "cyrillic": {"m": ["рин", "нор", "сон"], "f": ["лина", "рита", "нела"], "n": ["рис", "лен", "ким"]},
    "greek": {"m": ["ρης", "νος", "λης"], "f": ["λινα", "ριτα", "νελα"], "n": ["ρις", "λεν", "κιμ"]},
}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TITLES = "|".join([*FEMALE, *MALE, *NEUTRAL])


def _alternatives(words: list[str]) -> str:
    """The words as alternatives under their initials, so that one letter rules most of them out."""
    rest = {c: "|".join(sorted({w[1:] for w in words if w[0] == c}, reverse=True)) for c in sorted({w[0] for w in words})}
    return "|".join(f"{c}(?:{r})" for c, r in rest.items())


_GIVEN = _alternatives([*GIVEN_MALE, *GIVEN_FEMALE])
_NAME = r"\p{Lu}\p{L}+(?:[-'’]\p{L}+)*"
_BEFORE = rf"(?:(?:{'|'.join(PARTICLES)}) )"
#: Further words of a name, however many, with the particles before them; possessive, so that no length of name needs stack.
_FURTHER = rf"(?: {_BEFORE}*+{_NAME})"
_CONTEXTS = "|".join(f"(?i:{c})" for c in CONTEXTS)
# Cheap tests of the neighbouring characters come first, so that most places of a text are passed by at once.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "key": r"A(?<![A-Za-z0-9]A)KIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    # After a colon or an equals sign whatever stands there; else what has a digit and six characters.
    "secret": rf"(?<=[\s\"'=:>])(?=[^\s\"',;:=<>(){{}}\[\]])(?<=[:=][ \"'=>]{{0,12}}|(?i:bearer|basic) )(?!(?i:bearer|basic) )"
    rf"(?<=(?i:{TELLING})[ \"']{{0,3}}[:=][ \"'=>]{{0,12}}|(?i:{TELLING}|authorization)[ \"']{{0,3}}[:=][ \"'=>]{{0,12}}(?i:bearer|basic) )"
    r"(?=[^\s\"',;<>(){}\[\]]*[\p{L}\p{N}])[^\s\"',;<>(){}\[\]]+(?<!\.)"
    rf"|(?<=[^A-Za-z0-9\n])(?=[A-Za-z+/_.-]*\d)(?=[A-Za-z0-9+/_.-]{{6}})(?<=(?i:{TELLING})[^A-Za-z0-9\n]{{1,10}})[A-Za-z0-9+/_-]++(?:\.[A-Za-z0-9+/_-]++)*+",
    "iban": r"[A-Z](?<![A-Za-z0-9].)[A-Z]\d{2}(?:[A-Z0-9]{11,30}| [A-Z0-9]{4}(?: (?=[A-Z]{0,3}\d)[A-Z0-9]{4}){1,6}(?: (?=[A-Z]{0,2}\d)[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ip": rf"(?=\d)(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "ssn": r"(?=\d)(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?=[\d+(])(?<![\d+])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+\d(?:[ ./()-]{0,2}\d){7,14})(?!\d)",
    "card": r"(?=\d)(?<![\d+])(?:\d{13,19}|(?:\d{4}[ -]){3}\d{4}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)",
    "name": rf"(?=\p{{Lu}})(?<![\p{{L}}-])(?:(?:{_TITLES})\.? {_BEFORE}*+{_NAME}{_FURTHER}*+|(?:{_GIVEN})(?:[-'’]\p{{L}}+)*(?: \p{{Lu}}\.)*+{_FURTHER}++|(?<=(?:{_CONTEXTS}))(?!(?:{NO_NAMES})\b){_NAME}{_FURTHER}*+)",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: A text without a digit, an at sign, an access key, a word that tells a secret or a name holds no entity.
HINT, NAMES = "[0-9@]", rf"AKIA|(?i:{TELLING}|authorization)[ \"']{{0,3}}[:=]|{KINDS['name']}"
# Country calling codes of one and two digits; all others have three.
CALLING = (
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 "
    "93 94 95 98"
).split()


def kind_of(mention: Column) -> Column:
    """The first kind whose shape the whole mention has, 'none' for a number without a card's check digit; else a name or a secret.

    Names after an introduction and secrets are told by their context alone: a
    mention that begins with a capital and has no digit is a name.
    """
    out = None
    for k, p in KINDS.items():
        if k not in ("secret", "name"):
            test = mention.rlike(f"^(?:{p})$")
            out = F.when(test, k) if out is None else out.when(test, k)
    name = mention.rlike(rf"^[\p{{L}}.'’ -]+$") & mention.rlike(r"^\p{Lu}")
    kind = out.when(name, "name").otherwise("secret")
    return F.when((kind == "card") & (_luhn(F.regexp_replace(mention, r"\D", "")) != 0), "none").otherwise(kind)


def entities(kind: Column, mention: Column) -> Column:
    """array<struct<kind, canon, gender>>: what a mention is about, in canonical form; a name is one entity a word.

    The last word of a name of several words, or after a title, is the family
    name ('family'), others are given names ('given'); both have the gender that
    the name itself or the title tells ('n' if neither does). Initials and particles
    are no entity. A number after '+' is one with the same digits after '+' only,
    but for country code 1, which national numbers of ten digits leave out.
    """
    digits = F.regexp_replace(mention, r"\D", "")
    national = (~mention.startswith("+") & (F.length(digits) == 10)) | ((F.length(digits) == 11) & digits.startswith("1"))
    canon = (
        F.when(kind == "email", F.lower(mention))
        .when((kind == "phone") & national, F.right(digits, F.lit(10)))
        .when(kind == "phone", F.concat(F.lit("+"), digits))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "iban", F.replace(mention, F.lit(" "), F.lit("")))
        .otherwise(mention)
    )
    one = lambda k, c, g: F.struct(k.alias("kind"), c.alias("canon"), g.alias("gender"))
    titled = mention.rlike(rf"^(?:{_TITLES})\.? ")
    told = F.when(mention.rlike(rf"^(?:{'|'.join(FEMALE)})\b"), "f").when(mention.rlike(rf"^(?:{'|'.join(MALE)})\b"), "m").otherwise("n")

    def of_words(w: Column) -> Column:
        first = lambda c: F.substring_index(c, "-", 1)
        known = lambda c: F.when(first(c).isin(GIVEN_FEMALE), "f").when(first(c).isin(GIVEN_MALE), "m")

        def word(c: Column, i: Column) -> Column:
            last = (i == F.size(w) - 1) & ((F.size(w) > 1) | titled | known(c).isNull())
            c = _bare(c)
            return one(F.when(last, "family").otherwise("given"), F.lower(c), F.when(last, _family_gender(c, told)).otherwise(F.coalesce(known(c), told)))

        return F.transform(w, word)

    return F.when(kind == "name", let(_words(mention), of_words)).otherwise(F.array(one(kind, canon, F.lit("n"))))


def _words(mention: Column) -> Column:
    """The words of a name without title and initials, each with the particles before it."""
    bare = F.regexp_replace(mention, rf"^(?:{_TITLES})\.? ", "")
    return F.filter(F.split(bare, rf"(?<!(?:^| )(?:{'|'.join(PARTICLES)})) "), lambda w: ~w.rlike(r"^\p{Lu}\.$"))


def _bare(word: Column) -> Column:
    """A word of a name without particles."""
    return F.regexp_replace(word, rf"^{_BEFORE}+", "")


def _family_gender(word: Column, told: Column) -> Column:
    """The gender that a Cyrillic or Greek family name has by its ending; in Latin script what the title tells."""
    lower = F.lower(word)
    return (
        F.when(lower.rlike(r"[\p{IsCyrillic}]") & lower.rlike("[ая]$"), "f")
        .when(lower.rlike(r"[\p{IsCyrillic}]"), "m")
        .when(lower.rlike(r"[\p{IsGreek}]") & lower.rlike("ς$"), "m")
        .when(lower.rlike(r"[\p{IsGreek}]"), "f")
        .otherwise(told)
    )


def hmac(key: bytes, message: Column) -> Column:
    """HMAC-SHA-512 of a text as hexadecimal."""
    block = (hashlib.sha512(key).digest() if len(key) > 128 else key).ljust(128, b"\0")
    inner = F.sha2(F.concat(F.lit(bytes(x ^ 0x36 for x in block)), F.encode(message, "UTF-8")), 512)
    return F.sha2(F.concat(F.lit(bytes(x ^ 0x5C for x in block)), F.unhex(inner)), 512)


def _bytes(key: bytes, kind: Column, canon: Column, attempt: Column) -> Column:
    """Blocks of 64 keyed bytes as hex texts, together at least one byte for each character."""
    block = lambda k: hmac(key, F.concat_ws("\x1f", kind, attempt.cast("string"), k.cast("string"), canon))
    return F.transform(F.sequence(F.lit(0), F.floor(F.length(canon) / 64).cast("int")), block)


def _byte(stream: Column, i: Column) -> Column:
    """The i-th keyed byte (from 0)."""
    return F.conv(F.substring(F.get(stream, F.floor(i / 64).cast("int")), F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(of: str, at: Column) -> Column:
    return F.substring(F.lit(of), (at % len(of) + 1).cast("int"), F.lit(1))


def _characters(canon: Column, stream: Column, hexadecimal: Column) -> Column:
    """Digits, small and capital letters replaced by ASCII ones of their own kind, everything else kept."""

    def one(c: Column, i: Column) -> Column:
        b = _byte(stream, i)
        return (
            F.when(c.rlike("[1-9]"), _pick("123456789", b))
            .when(c == "0", _pick("0123456789", b))
            .when(c.rlike("[a-z]"), F.when(hexadecimal, _pick("abcdef", b)).otherwise(_pick("abcdefghijklmnopqrstuvwxyz", b)))
            .when(c.rlike(r"\p{Lu}"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", b))
            .when(c.rlike(r"\p{L}"), _pick("abcdefghijklmnopqrstuvwxyz", b))
            .when(c.rlike(r"\p{N}"), _pick("123456789", b))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(canon, ""), one), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10."""
    at = F.sequence(F.lit(1), F.length(digits))

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d >= 5, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(at, F.lit(0), add) % 10


def _mod97(text: Column) -> Column:
    """The number spelt by digits and letters (A = 10), modulo 97."""

    def add(acc: Column, c: Column) -> Column:
        v = F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return F.when(v < 10, acc * 10 + v).otherwise(acc * 100 + v) % 97

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), add)


def _name(canon: Column, gender: Column, stream: Column, attempt: Column) -> Column:
    """A made-up word in the script of `canon` with an ending for the gender, one for each hyphenated part; later attempts are longer."""
    at = lambda i: _byte(stream, F.pmod(i, F.lit(64)))

    def made(script: str) -> Column:
        parts = F.array(*map(F.lit, SYLLABLES[script]))
        ends = {g: F.array(*map(F.lit, x)) for g, x in ENDINGS[script].items()}
        pick = lambda a, i: F.element_at(a, (at(i) % F.size(a) + 1).cast("int"))
        end = lambda i: F.when(gender == "m", pick(ends["m"], i)).when(gender == "f", pick(ends["f"], i)).otherwise(pick(ends["n"], i))
        many = F.lit(2) + F.floor(attempt / 4).cast("int")

        def word(w: Column, i: Column) -> Column:
            body = F.transform(F.sequence(F.lit(0), many), lambda k: pick(parts, i * 16 + k))
            return F.concat(F.array_join(body, ""), end(i * 16 + 15))

        return F.array_join(F.transform(F.split(canon, "[-'’]"), word), "-")

    return F.when(canon.rlike(r"\p{IsCyrillic}"), made("cyrillic")).when(canon.rlike(r"\p{IsGreek}"), made("greek")).otherwise(made("latin"))


def surrogate(key: bytes, kind: Column, canon: Column, gender: Column, attempt: Column) -> Column:
    """The surrogate of a canonical form, in canonical form."""

    def made(stream: Column) -> Column:
        hexadecimal = canon.rlike("^[0-9a-f]+$")
        plain = lambda text: _characters(text, stream, hexadecimal)
        top = F.regexp_extract(canon, r"\.[^.]+$", 0)
        email = F.concat(plain(F.regexp_replace(canon, r"\.[^.]+$", "")), top)
        ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_byte(stream, i) % 254 + 1).cast("string")), ".")
        body = plain(canon)
        # Short secrets may be more than their format has room for: later attempts are longer.
        grown = F.concat(body, F.array_join(F.transform(F.sequence(F.lit(1), F.floor(attempt / 4).cast("int") + 1), lambda i: F.when(i * 4 <= attempt, _pick("abcdefghijklmnopqrstuvwxyz", _byte(stream, F.pmod(i, F.lit(64))))).otherwise("")), ""))
        after = lambda n: F.substring(body, n + 1, F.length(body))
        head = F.substring(body, F.lit(1), F.length(body) - 1)
        card = F.concat(head, ((10 - _luhn(F.concat(head, F.lit("0")))) % 10).cast("string"))
        country, account = F.substring(canon, 1, 2), after(F.lit(4))
        iban = F.concat(country, F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0"), account)
        code = F.regexp_extract(canon, rf"^\+(?:{'|'.join(CALLING)}|\d{{3}})", 0)
        phone = F.when(canon.startswith("+"), F.concat(code, after(F.length(code)))).otherwise(body)
        return (
            F.when(kind == "email", email)
            .when(kind == "key", F.concat(F.substring(canon, 1, 4), after(F.lit(4))))
            .when(kind == "ip", ip)
            .when(kind == "card", card)
            .when(kind == "iban", iban)
            .when(kind == "phone", phone)
            .when(kind.isin("given", "family"), _name(canon, gender, stream, attempt))
            .when(kind == "secret", grown)
            .otherwise(body)
        )

    return let(_bytes(key, kind, canon, attempt), made)


def formatted(kind: Column, mention: Column, cores: Column) -> Column:
    """The surrogates of a mention's entities written the way `mention` is."""
    core = F.element_at(cores, 1)
    chars = F.split(mention, "")
    plain = F.replace(core, F.lit("+"), F.lit(""))
    count = F.length(F.regexp_replace(mention, r"\D", ""))
    ahead = lambda i: F.length(F.regexp_replace(F.substring(mention, F.lit(1), i), r"\D", ""))
    at = lambda i: ahead(i) - (count - F.length(plain)) + 1  # noqa: E731  digits are set from the right: the code of a national number stays
    digits = F.array_join(
        F.transform(chars, lambda c, i: F.when(c.rlike(r"\d") & (at(i) >= 1), F.substring(plain, at(i), F.lit(1))).otherwise(c)), ""
    )
    cased = F.array_join(F.zip_with(chars, F.split(core, ""), lambda c, d: F.when(c.rlike(r"\p{Lu}"), F.upper(d)).otherwise(d)), "")
    letters = lambda i: F.length(F.replace(F.substring(mention, F.lit(1), i), F.lit(" "), F.lit("")))
    spaced = F.array_join(F.transform(chars, lambda c, i: F.when(c == " ", c).otherwise(F.substring(core, letters(i) + 1, F.lit(1)))), "")
    title = F.regexp_extract(mention, rf"^(?:{_TITLES})\.? ", 0)
    ahead_of = lambda w: F.regexp_extract(w, rf"^{_BEFORE}+", 0)
    capital = lambda w, c: F.when((w == F.upper(w)) & (F.length(w) > 1), F.upper(c)).otherwise(
        F.array_join(F.transform(F.split(c, "-"), lambda x: F.initcap(x)), "-")
    )
    name = F.concat(title, F.array_join(F.zip_with(_words(mention), cores, lambda w, c: F.concat(ahead_of(w), capital(_bare(w), c))), " "))
    return (
        F.when(kind == "email", cased)
        .when(kind.isin("phone", "card", "ssn"), digits)
        .when(kind == "iban", spaced)
        .when(kind == "name", name)
        .when(kind == "none", mention)
        .otherwise(core)
    )


def entity_map(mentions: DataFrame, key: str) -> DataFrame:
    """(mention) -> (mention, kind, surrogate), one row per distinct mention; kind 'none' for what is no entity after all.

    Entities of one kind have distinct surrogates, none of which is an entity
    that was found; a few draws settle that. Draws go on while they settle
    entities; after PATIENCE that settle none an error tells that a format is too
    small for its entities. A name with titles of both
    genders has neither.
    """
    secret = key.encode()
    distinct = mentions.distinct().withColumn("kind", kind_of(F.col("mention")))
    parts = written(
        distinct.select("mention", "kind", F.posexplode(entities(F.col("kind"), F.col("mention"))).alias("at", "e")).select(
            "mention", F.col("kind").alias("shape"), "at", "e.kind", "e.canon", "e.gender"
        ),
        "mentions",
    )
    told = F.collect_set(F.when(F.col("gender") != "n", F.col("gender")))
    drawn = parts.where("shape <> 'none'").groupBy("kind", "canon").agg(told.alias("g"))
    drawn = drawn.select("kind", "canon", F.when(F.size("g") == 1, F.element_at("g", 1)).otherwise("n").alias("gender"), F.lit(0).alias("attempt"))
    fresh_core = surrogate(secret, F.col("kind"), F.col("canon"), F.col("gender"), F.col("attempt"))
    drawn = written(drawn.withColumn("core", fresh_core), "drawn")
    least, idle = None, 0
    while True:
        first = drawn.groupBy("kind", "core").agg(F.min("canon").alias("first"), F.count("*").alias("n")).where("n > 1")
        found = drawn.select("kind", F.col("canon").alias("core"), F.lit(True).alias("found"))
        judged = (
            drawn.join(first.select("kind", "core", "first"), ["kind", "core"], "left")
            .join(found, ["kind", "core"], "left")
            .withColumn("bad", (F.coalesce("first", "canon") != F.col("canon")) | F.col("found").isNotNull())
        )
        judged = written(judged.select("kind", "canon", "gender", "attempt", "core", "bad"), "judged")
        bad = judged.where("bad").count()
        if not bad:
            discard(judged)
            break
        least, idle = (bad, 0) if least is None or bad < least else (least, idle + 1)
        if idle > PATIENCE:
            raise RuntimeError("no distinct surrogates for some kind of entity")
        again = judged.withColumn("attempt", F.when(F.col("bad"), F.col("attempt") + 1).otherwise(F.col("attempt")))
        old = drawn
        drawn = written(again.withColumn("core", F.when(F.col("bad"), fresh_core).otherwise(F.col("core"))).drop("bad"), "drawn")
        discard(old, judged)
    whole = parts.join(drawn.select("kind", "canon", "core"), ["kind", "canon"], "left").groupBy("mention", "shape").agg(
        F.array_sort(F.collect_list(F.struct("at", "core"))).alias("c")
    )
    made = formatted(F.col("shape"), F.col("mention"), F.transform("c", lambda x: x["core"]))
    return whole.select("mention", F.col("shape").alias("kind"), made.alias("surrogate"))


def surrogated(docs: DataFrame, key: str, counts: bool = False) -> DataFrame:
    """The documents with every detected entity in `text` replaced; other columns as they are.

    `key` keeps the surrogates from being traced; whoever has it can draw them
    again. With `counts`, n_mentions long is added (in place of a column of that
    name). Null and empty texts, and texts without an entity, come back
    unchanged, texts of any length are read whole. Equal texts change alike,
    whatever their ids; a mention has one surrogate in the whole table. Columns
    of any name pass through.
    """
    if not key:
        raise ValueError("surrogates need a key")
    text = F.col("text").cast("string")
    has = F.when(text.rlike(HINT), True).otherwise(F.coalesce(text.rlike(NAMES), F.lit(False)))
    found = docs.where(has).select(
        F.xxhash64(text).alias("h"), F.octet_length(text).alias("l"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)).alias("mentions")
    )
    found = written(found.where(F.size("mentions") > 0).groupBy("h", "l").agg(F.first("mentions").alias("mentions")), "found")
    table = written(entity_map(found.select(F.explode(F.array_distinct("mentions")).alias("mention")), key), "surrogates")
    each = found.select("h", "l", F.posexplode("mentions").alias("at", "mention"))
    each = each.join(F.broadcast(table) if broadcastable(table, BROADCAST_ROWS) else table, "mention")
    per_text = each.groupBy("h", "l").agg(
        F.array_sort(F.collect_list(F.struct("at", "surrogate"))).alias("s"), F.count(F.when(F.col("kind") != "none", 1)).alias("n")
    )
    hash_, size, made, many = (fresh(c, docs) for c in ("hash__", "size__", "made__", "many__"))
    per_text = written(
        per_text.where("n > 0").select(F.col("h").alias(hash_), F.col("l").alias(size), F.transform("s", lambda x: x["surrogate"]).alias(made), F.col("n").alias(many)),
        "per_text",
    )
    discard(found, table)

    def joined(between: Column) -> Column:
        pairs = F.zip_with(made, F.slice(between, F.lit(1), F.size(made)), lambda m, b: F.concat(b, m))
        return F.concat(F.array_join(pairs, ""), F.element_at(between, -1))

    def replaced(rows: DataFrame, maps: DataFrame) -> DataFrame:
        key = (F.xxhash64(text) == F.col(hash_)) & (F.octet_length(text) == F.col(size))
        new = F.when(F.col(made).isNull(), text).otherwise(let(F.split(text, PATTERN, -1), joined))
        out = rows.join(maps, key, "left").withColumn("text", new)
        return out.withColumn("n_mentions", F.coalesce(many, F.lit(0)).cast("long")) if counts else out

    columns = [*(c for c in docs.columns if not (counts and c.lower() == "n_mentions")), *["n_mentions"] * counts]
    if broadcastable(per_text, BROADCAST_ROWS):
        return replaced(docs, F.broadcast(per_text)).select(columns)
    # Only texts that may hold an entity meet the maps; all others pass by the shuffle.
    plain = docs.where(~has)
    plain = plain.withColumn("n_mentions", F.lit(0).cast("long")) if counts else plain
    return plain.select(columns).union(replaced(docs.where(has), per_text).select(columns))
