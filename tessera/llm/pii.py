"""Operator 5: surrogates for personal data, in DataFrame operations only.

Detected entities are replaced by surrogates that depend on a key, the entity's kind and
its normalised form only, so an entity has the same surrogate wherever it occurs
(coreference), and keep kind and format: letters, digits, case, separators, and script
and gender of names. A person's name is a given and a family name, each an entity of its
own: mentions that share a family name share its surrogate, and within a text that has
a titled full name, its bare and family-name mentions are replaced alike.

Distinct entities must keep distinct surrogates: the distinct entities of all texts are
gathered, surrogates that two entities share, or that are themselves an entity of the
corpus, are found in one aggregate, and all but one of their owners move on to their next
attempt, until none is left. Only those that move are looked at again. Every few attempts
make surrogates longer, so the rounds end however many entities there are. Attempts above
zero are few; they are joined to the texts that need them and to no others.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, let, small, staged, text_of, without

KEY = "surrogates-1"

#: Titles of women, of men and of either.
TITLES = {
    "woman": "Mrs Ms Miss Frau Madame Mme Señora Sra Госпожа".split(),
    "man": "Mr Herr Monsieur Señor Sr Господин".split(),
    "person": "Dr Prof Professor Доктор Профессор".split(),
}
NAMES = tuple(TITLES)
TITLE = rf"^((?:{'|'.join(w for words in TITLES.values() for w in words)})\.?\x20)"

#: Kinds in order of precedence where matches meet; (kind, pattern).
KINDS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"),
    ("card", r"(?<![0-9A-Za-z])(?:[0-9]{4}[ -]?){3}[0-9]{4}(?![0-9A-Za-z])"),
    ("phone", r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9A-Za-z])|(?<![0-9A-Za-z+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])"),
    ("ssn", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    ("ip", r"(?<![0-9A-Za-z.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9A-Za-z]|\.[0-9])"),
    *((kind, rf"(?<![\p{{L}}])(?:{'|'.join(words)})\.?\x20\p{{Lu}}[\p{{Ll}}'-]+(?:\x20\p{{Lu}}[\p{{Ll}}'-]+)?") for kind, words in TITLES.items()),
)
#: One scan finds all kinds: leftmost, then in the order above.
ANY = "|".join(f"(?:{p})" for _, p in KINDS)
NUMBERS = ("card", "phone", "ssn")

#: Given names by gender and script, family name parts by script.
GIVEN = {
    ("woman", "latin"): "Anna Clara Diana Elena Flora Greta Hanna Irene Julia Laura Maria Nora Olivia Paula Rosa Sofia Teresa Vera".split(),
    ("man", "latin"): "Adam Bruno Carl Daniel Emil Felix Georg Hugo Ivan Jonas Karl Leo Martin Oscar Paul Robert Simon Victor".split(),
    ("person", "latin"): "Alex Ariel Charlie Dominique Eike Jules Kim Luca Noel Quinn Robin Sascha".split(),
    ("woman", "cyrillic"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга".split(),
    ("man", "cyrillic"): "Антон Борис Иван Максим Олег Павел Роман Юрий".split(),
    ("person", "cyrillic"): "Женя Саша Валя Слава".split(),
}
FAMILY = {
    "latin": ("Bel Cor Dal Fer Gar Hol Kel Lam Mar Nor Pal Ros Sal Tor Val Wen".split(), "ba de fi go la mi no ra se ti vo zu".split(), "berg dale ford lin man ner res son ton well".split()),
    "cyrillic": ("Бел Вол Гор Кор Лаз Мор Пол Сол".split(), "ба ве ги до ле ми но ру".split(), "ин ков лев нов ров ский".split()),
}
#: Endings of Cyrillic family names, of men and of women.
ENDINGS = (("ский", "ская"), ("цкий", "цкая"), ("ов", "ова"), ("ев", "ева"), ("ин", "ина"))
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _list(words: list[str]) -> Column:
    return F.from_json(F.lit(json.dumps(words)), "array<string>")


def kind_of(entity: Column) -> Column:
    """The first kind whose pattern fits the whole match."""
    case = None
    for kind, pattern in KINDS:
        fits = entity.rlike(f"^(?:{pattern})$")
        case = F.when(fits, F.lit(kind)) if case is None else case.when(fits, F.lit(kind))
    return case


def normal_form(kind: Column, entity: Column) -> Column:
    """What coreferent mentions share: digits of numbers, lower case of addresses. Two
    forms of a number are one entity."""
    digits = F.regexp_replace(entity, "[^0-9]", "")
    return F.when(kind.isin(*NUMBERS), digits).when(kind == "email", F.lower(entity)).otherwise(entity)


def _gendered(family: Column, to_woman: bool) -> Column:
    """A Cyrillic family name in the other form, if it has one of ENDINGS."""
    case = None
    for man, woman in ENDINGS:
        old, new = (man, woman) if to_woman else (woman, man)
        turned = F.concat(F.substr(family, F.lit(1), F.length(family) - len(old)), F.lit(new))
        case = F.when(F.endswith(family, F.lit(old)), turned) if case is None else case.when(F.endswith(family, F.lit(old)), turned)
    return case.otherwise(family)


def name_parts(kind: Column, name: Column) -> Column:
    """Array of (kind, normal) of a name without its title: the given name, if there are two
    words, by gender, and the family name, in the form of a man."""
    words = F.split(name, " ")
    family = F.lower(F.element_at(words, -1))
    family = F.struct(F.lit("family").alias("kind"), F.when(kind == "woman", _gendered(family, False)).otherwise(family).alias("normal"))
    given = F.struct(F.concat(F.lit("given-"), kind).alias("kind"), F.lower(F.get(words, F.lit(0))).alias("normal"))
    return F.when(F.size(words) > 1, F.array(given, family)).otherwise(F.array(family))


def _draw(digest: Column, i: Column, n: int) -> Column:
    """A number below n from the digest: six hex digits from place i on, turning around."""
    at = (i * 5 % 58) + 1
    return F.conv(F.substr(digest, at.cast("int"), F.lit(6)), 16, 10).cast("long") % n


def _alike(s: Column, digest: Column) -> Column:
    """s with every ASCII letter and digit replaced by one of its class."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")

    def one(c: Column, i: Column) -> Column:
        case = F.when(c.between("0", "9"), F.substr(F.lit(DIGITS), (_draw(digest, i, 10) + 1).cast("int"), F.lit(1)))
        case = case.when(c.between("a", "z"), F.substr(F.lit(LOWER), (_draw(digest, i, 26) + 1).cast("int"), F.lit(1)))
        return case.when(c.between("A", "Z"), F.substr(F.lit(UPPER), (_draw(digest, i, 26) + 1).cast("int"), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(chars, one), "")


def _digits_in(s: Column, digits: Column) -> Column:
    """s with its digits replaced, in order, by those of another string."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    step = F.aggregate(
        chars,
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda acc, c: F.when(c.between("0", "9"), F.struct(F.concat(acc["out"], F.substr(digits, acc["at"], F.lit(1))).alias("out"), (acc["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["at"].alias("at"))),
    )
    return step["out"]


def digest_of(kind: Column, normal: Column, attempt: Column, key: str = KEY) -> Column:
    """Keyed: nested SHA-256, as in HMAC."""
    inner = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, attempt.cast("string"), normal), 256)
    return F.sha2(F.concat(F.lit(key + "\x1e"), inner), 256)


def _pick(words: list[str], d: Column, i: int) -> Column:
    return F.get(_list(words), _draw(d, F.lit(i), len(words)).cast("int"))


def surrogate_normal(kind: Column, normal: Column, attempt: Column, key: str = KEY) -> Column:
    """The normal form of an entity's surrogate at an attempt.

    E-mail addresses keep lengths and separators of the local part and get a domain below
    the reserved .invalid, the same for a domain; phone numbers keep their country digit;
    addresses become private ones of 10/8, after three attempts reserved ones of 240/4;
    cards start with 9 (no issuer does). Names come from lists; from the second attempt on
    given names, and every fourth attempt family names, get a further part. From the eighth
    attempt on all else gets further digits, more at each attempt.
    """

    def longer(made: Column, d: Column, by: str) -> Column:
        digits = F.translate(F.substr(d, F.lit(20), F.least(attempt - 6, F.lit(40)).cast("int")), "abcdef", "012345")
        return F.when(attempt < 8, made).otherwise(F.concat(made, F.lit(by), digits))

    def parts(d: Column, script: str, n: Column) -> Column:
        """n further parts of a name, from digests of their own."""
        a, b, _ = FAMILY[script]
        each = F.transform(F.sequence(F.lit(1), n), lambda i: let(F.sha2(F.concat(d, i.cast("string")), 256), lambda x: F.concat(F.lit("-"), _pick(a, x, 0), _pick(b, x, 1), _pick(b, x, 2))))
        return F.when(n < 1, F.lit("")).otherwise(F.array_join(each, ""))

    def named(d: Column) -> Column:
        cyrillic = normal.rlike(r"\p{IsCyrillic}")
        case = F.when(F.lit(False), F.lit(""))
        for script, (a, b, c) in FAMILY.items():
            fits = cyrillic if script == "cyrillic" else ~cyrillic
            # The ending comes last: it follows the gender.
            case = case.when(fits & (kind == "family"), F.concat(_pick(a, d, 1), *[_pick(b, d, i) for i in (3, 4, 5)], parts(d, script, F.floor(attempt / 4).cast("int")), _pick(c, d, 2)))
            for gender in NAMES:
                case = case.when(fits & (kind == f"given-{gender}"), F.concat(_pick(GIVEN[gender, script], d, 0), parts(d, script, F.ceil(attempt / 2).cast("int"))))
        return case

    def made(d: Column) -> Column:
        local, domain = F.regexp_extract(normal, "^([^@]*)@", 1), F.regexp_extract(normal, "@(.*)$", 1)
        # The length of very short local parts is not kept: it would leave too few surrogates.
        local = F.when(F.length(local) < 8, F.concat(local, F.substr(F.lit("aaaaaaaa"), F.lit(1), F.lit(8) - F.length(local)))).otherwise(local)
        site = _alike(F.lit("aaaaaa"), digest_of(F.lit("domain"), domain, F.lit(0), key))
        email = F.concat(longer(_alike(local, d), d, ""), F.lit("@"), site, F.lit(".invalid"))
        number = _alike(normal, d)
        card = F.concat(F.lit("9"), F.substr(number, F.lit(2), F.lit(100)))
        phone = F.concat(F.substr(normal, F.lit(1), F.lit(1)), F.substr(number, F.lit(2), F.lit(100)))
        top = F.when(attempt < 3, F.lit("10")).otherwise((_draw(d, F.lit(9), 15) + 240).cast("string"))
        ip = F.concat_ws(".", top, *[_draw(d, F.lit(i), 256).cast("string") for i in range(3)])
        return (
            F.when(kind == "email", email).when(kind == "card", longer(card, d, "")).when(kind == "phone", longer(phone, d, ""))
            .when(kind == "ssn", longer(number, d, "")).when(kind == "ip", longer(ip, d, ".")).otherwise(named(d))
        )

    return let(digest_of(kind, normal, attempt, key), made)


def in_format(kind: Column, entity: Column, made: Column) -> Column:
    """The surrogate's normal form in the format of a mention that is no name."""
    local = F.regexp_extract(entity, "^([^@]*)@", 1)
    email = F.when(local.rlike("[A-Z]") & ~local.rlike("[a-z]"), F.upper(made)).otherwise(made)
    return F.when(kind.isin(*NUMBERS), _digits_in(entity, made)).when(kind == "email", email).otherwise(made)


PART = "struct<kind:string,normal:string>"
MENTION = f"array<struct<kind:string,entity:string,parts:array<{PART}>>>"


def may_have(text: Column) -> Column:
    """Does a text have what every match has: a digit, an @, or a title?"""
    out = text.rlike("[0-9@]")
    for word in sorted({w for words in TITLES.values() for w in words}):
        out = out | text.contains(word)
    return out


def mentions(text: Column) -> Column:
    """Array of (kind, entity, parts) in text order; parts are what surrogates are made for."""

    def described(e: Column) -> Column:
        def parts(k: Column) -> Column:
            own = F.array(F.struct(k.alias("kind"), normal_form(k, e).alias("normal")))
            return F.struct(k.alias("kind"), e.alias("entity"), F.when(k.isin(*NAMES), name_parts(k, F.regexp_replace(e, TITLE, ""))).otherwise(own).alias("parts"))

        return let(kind_of(e), parts)

    found = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), described).cast(MENTION)
    return F.when(may_have(text), found).otherwise(F.array().cast(MENTION))


def pattern_of(found: Column) -> Column:
    """ANY, and behind it the bare and family names of the titled full names among the mentions."""
    full = F.filter(found, lambda m: m["kind"].isin(*NAMES) & F.regexp_replace(m["entity"], TITLE, "").contains(" "))
    bare = F.array_distinct(F.transform(full, lambda m: F.regexp_replace(m["entity"], TITLE, "")))
    family = F.array_distinct(F.transform(bare, lambda n: F.substring_index(n, " ", -1)))
    # Names hold letters, ' and - only, so they need no quoting.
    return F.when(F.size(bare) == 0, F.lit(ANY)).otherwise(F.concat(F.lit(ANY + r"|(?<![\p{L}])(?:"), F.array_join(F.concat(bare, family), "|"), F.lit(r")(?![\p{L}'-])")))


def all_mentions(text: Column, first: Column) -> Column:
    """mentions(text), given as `first`, and those of names without a title that belong to one with it."""

    def again(m: Column) -> Column:
        def described(e: Column) -> Column:
            titled = F.filter(m, lambda x: x["entity"] == e)
            whole = F.filter(m, lambda x: x["kind"].isin(*NAMES) & (F.regexp_replace(x["entity"], TITLE, "") == e))
            family = F.filter(m, lambda x: x["kind"].isin(*NAMES) & F.endswith(x["entity"], F.concat(F.lit(" "), e)))
            owner = F.coalesce(F.get(whole, F.lit(0)), F.get(family, F.lit(0)))
            parts = F.when(e.contains(" "), owner["parts"]).otherwise(F.slice(owner["parts"], -1, 1))
            bare = F.struct(owner["kind"].alias("kind"), e.alias("entity"), parts.alias("parts"))
            return F.coalesce(F.get(titled, F.lit(0)), bare)

        return F.transform(F.regexp_extract_all(text, pattern_of(m), F.lit(0)), described).cast(MENTION)

    return let(first, lambda m: F.when(F.exists(m, lambda x: x["kind"].isin(*NAMES)), again(m)).otherwise(m))


def _digest(kind: Column, normal: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x1f", kind, normal), 256), 1, 30)


def later_attempts(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, normal, attempt) of the entities that can't keep attempt zero.

    entities: distinct (kind, normal). Of those that share a surrogate the smallest digest
    keeps it, the others go on; a surrogate that is an entity itself is kept by nobody.
    Surrogates and entities meet in one aggregate. In further rounds the few that move
    are compared with all that was given out before, which they are sent to.
    """
    own = _digest(F.col("kind"), F.col("normal"))

    def tried(rows: DataFrame) -> DataFrame:
        made = F.lower(surrogate_normal(F.col("kind"), F.col("normal"), F.col("attempt"), key))
        return rows.select("kind", "normal", "attempt", made.alias("made"), own.alias("id"))

    first = staged(tried(entities.select("kind", "normal", F.lit(0).alias("attempt"))), "pii-first")
    given = first.select("kind", "made").unionByName(first.select("kind", F.lower("normal").alias("made")))
    owners = first.select("kind", "made", "id").unionByName(first.select("kind", F.lower("normal").alias("made"), F.lit(None).cast("string").alias("id")))
    clash = owners.groupBy("kind", "made").agg(F.count("id").alias("n"), F.count("*").alias("all"), F.min("id").alias("keeper")).filter("n > 0 and all > 1")
    clash = staged(clash.select("kind", "made", F.when(F.col("all") == F.col("n"), F.col("keeper")).alias("keeper")), "pii-clashes")
    moving = staged(first.join(small(clash), ["kind", "made"]).filter("keeper is null or keeper <> id").select("kind", "normal", F.lit(1).alias("attempt")), "pii-moving")
    settled = None
    while not moving.isEmpty():
        now = staged(tried(moving), "pii-tried")
        hit = given.join(small(now.select("kind", "made").distinct()), ["kind", "made"], "left_semi").distinct().withColumn("hit", F.lit(True))
        keeper = now.groupBy("kind", "made").agg(F.min("id").alias("keeper"))
        now = staged(now.join(keeper, ["kind", "made"]).join(hit, ["kind", "made"], "left").withColumn("stays", F.col("hit").isNull() & (F.col("id") == F.col("keeper"))), "pii-judged")
        kept = now.filter("stays").select("kind", "normal", "attempt")
        settled = kept if settled is None else settled.unionByName(kept)
        given = given.unionByName(now.select("kind", "made"))
        moving = now.filter("not stays").select("kind", "normal", (F.col("attempt") + 1).alias("attempt"))
    return settled if settled is not None else first.filter("false").select("kind", "normal", "attempt")


LATER = "array<struct<kind:string,normal:string,attempt:int>>"


def replace(docs: DataFrame, text: str = "text", key: str = KEY, found: str | None = None) -> DataFrame:
    """docs with the entities of a text replaced; `found`, if given, names an array
    column of (kind, entity, surrogate) that is added.

    Names count behind a title; bare ones only in a text that has them with one. A null text
    stays null; an empty text stays empty; texts without entities don't change. Repeated
    rows stay repeated, alike. An empty table gives an empty result. A column of docs
    named like `found` gives way to it.
    """
    if found:
        docs = without(docs, [found])
    # Texts are told apart by digest, so no row id is needed.
    rows = docs.withColumn("__pii_m", mentions(text_of(text))).withColumn("__pii_m", all_mentions(text_of(text), F.col("__pii_m")))
    rows = rows.withColumn("__pii_id", F.when(F.size("__pii_m") > 0, F.sha2(text_of(text), 256)))
    listed = rows.filter("__pii_id is not null").select("__pii_id", F.explode(F.array_distinct(F.flatten(F.col("__pii_m.parts")))).alias("part"))
    listed = staged(listed.select("__pii_id", "part.kind", "part.normal"), "pii-mentions")
    entities = staged(listed.select("kind", "normal").distinct(), "pii-entities")
    later = staged(later_attempts(entities, key), "pii-later")

    if later.isEmpty():
        rows = rows.withColumn("__pii_later", F.array().cast(LATER))
    else:
        got = listed.distinct().join(small(later), ["kind", "normal"]).groupBy("__pii_id").agg(F.sort_array(F.collect_list(F.struct("kind", "normal", "attempt"))).alias("__pii_later"))
        got = staged(got, "pii-texts")
        # Broadcast by the number of attempts that all its rows hold.
        held = got.agg(F.coalesce(F.sum(F.size("__pii_later")), F.lit(0))).first()[0]
        rows = rows.join(small(got, held), "__pii_id", "left")

    def of_part(p: Column, later_: Column) -> Column:
        hit = F.filter(F.coalesce(later_, F.array().cast(LATER)), lambda x: (x["kind"] == p["kind"]) & (x["normal"] == p["normal"]))
        return surrogate_normal(p["kind"], p["normal"], F.coalesce(F.get(hit, F.lit(0))["attempt"], F.lit(0)), key)

    def one(m: Column, later_: Column) -> Column:
        def joined(made: Column) -> Column:
            family = F.element_at(made, -1)
            family = F.when(m["kind"] == "woman", _gendered(family, True)).otherwise(family)
            whole = F.when(F.size(made) > 1, F.concat_ws(" ", F.get(made, F.lit(0)), family)).otherwise(family)
            title = F.regexp_extract(m["entity"], TITLE, 1)  # empty for a bare name
            return F.when(m["kind"].isin(*NAMES), F.concat(title, whole)).otherwise(in_format(m["kind"], m["entity"], F.get(made, F.lit(0))))

        return F.struct(m["kind"].alias("kind"), m["entity"].alias("entity"), let(F.transform(m["parts"], lambda p: of_part(p, later_)), joined).alias("surrogate"))

    rows = rows.withColumn("__pii_found", F.transform("__pii_m", lambda m: one(m, F.col("__pii_later"))))
    gaps = F.split(F.col(text), pattern_of(F.col("__pii_m")), -1)
    whole = F.concat(F.array_join(F.zip_with(F.slice(gaps, F.lit(1), F.size("__pii_found")), F.col("__pii_found"), lambda g, m: F.concat(g, m["surrogate"])), ""), F.element_at(gaps, -1))
    new = F.when(F.size("__pii_found") == 0, F.col(text)).otherwise(whole)
    columns = [new.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return rows.select(*columns, *([F.col("__pii_found").alias(found)] if found else []))


def op5_surrogates(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rows = replace(docs, found="found")

    def n(kind: str) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.select("doc_id", "text", F.size("found").cast("long").alias("n_entities"), *[n(kind) for kind, _ in KINDS])
