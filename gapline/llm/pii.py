"""Replacing personal data by surrogates, in DataFrame functions only.

Detected: e-mail addresses, IPv4 addresses, phone numbers, card numbers, US social security numbers, secrets (long hexadecimal
strings and keys of well-known shapes) and names of persons behind a title, with later or earlier mentions of such a name in the
same document that have no title. An entity is made of one or more units, each of which gets a surrogate of its own kind, drawn
from a keyed hash: same length and punctuation, digits for digits, letters for letters, capitals for capitals; the Luhn remainder of
a card stays. Addresses consist of a local part and a domain, names of a given and a family name, so that addresses of one domain
stay so and Mr Smith and Mr John Smith share their family name. Names keep the gender of their title and their script (Latin,
Cyrillic, Greek).

The same unit gets the same surrogate everywhere, however it is written (``coreference``); different units of a kind get different
ones, and no surrogate is a unit of the corpus (``distinctness``): collisions are found by grouping the surrogates and draws are
repeated, for all but the unit that sorts first. Names, domains and local parts get longer with the draws, so there are always some
left. Numbers can't: where ``DRAWS`` draws leave collisions in a format, all its numbers go through a keyed permutation of the format,
which keeps them distinct; only then may a surrogate be a number that stands elsewhere. Without the key, surrogates can't be traced back.

Only the texts with entities are shuffled, and only the distinct units are drawn for, added up in each task first.

Defined cases: null text stays null, with no entity; empty text stays; very long texts are read whole, by patterns that need no stack
for repeated parts; rows that agree in id and text share one result each; an empty table gives an empty result; other columns are
ignored by ``replace``; ``n_entities`` doesn't count names without a title.
"""

from __future__ import annotations

import functools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapline.llm.common import Scratch

KEY = "gapline-surrogates"

# Titles that tell the gender, and given names by script and gender.
TITLES = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "господин", "Господин", "κύριος", "Κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа", "Госпожа", "κυρία", "Κυρία"),
}
GIVEN = {
    ("latin", "m"): ("Adam", "Bruno", "Carl", "Daniel", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Leon", "Marco", "Noel", "Oscar", "Paul", "Robin", "Simon"),
    ("latin", "f"): ("Anna", "Bella", "Clara", "Diana", "Emma", "Flora", "Greta", "Helena", "Irene", "Julia", "Laura", "Maria", "Nora", "Olga", "Paula", "Sonia"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Игорь", "Кирилл", "Лев", "Максим", "Олег", "Павел", "Роман", "Семён", "Тимур", "Фёдор"),
    ("cyrillic", "f"): ("Анна", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса", "София", "Татьяна"),
    ("greek", "m"): ("Άρης", "Βασίλης", "Γιώργος", "Δημήτρης", "Ηλίας", "Θάνος", "Κώστας", "Λουκάς", "Μάριος", "Νίκος", "Πέτρος", "Σπύρος"),
    ("greek", "f"): ("Άννα", "Βέρα", "Γεωργία", "Δήμητρα", "Ελένη", "Ζωή", "Ηρώ", "Κατερίνα", "Μαρία", "Νίκη", "Σοφία", "Χριστίνα"),
}
#: Syllables of family names.
SYLLABLES = {
    "latin": ("ba", "den", "fi", "gor", "hal", "ka", "len", "mar", "no", "pel", "ra", "sen", "tor", "va", "wil", "zan"),
    "cyrillic": ("ба", "вен", "го", "дар", "зи", "кол", "ла", "мир", "но", "пет", "ро", "сол", "та", "фед", "шу", "яр"),
    "greek": ("βα", "γο", "δα", "θε", "κα", "λι", "μα", "νο", "πα", "ρι", "σα", "το"),
}

#: Java's patterns take stack for each repetition of a group that may be undone; repeated groups are possessive or bounded here.
EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@(?!\.)[A-Za-z0-9.\-]*(?<![.@])\.[A-Za-z]{2,}+(?![A-Za-z0-9\-])"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IP = rf"(?<![\w.]){OCTET}(?:\.{OCTET}){{3}}(?![\w]|\.\d)"
PHONE = r"(?<![\w+])\+\d{1,3}[ .\-]?\(?\d{2,4}\)?(?:[ .\-]?\d{2,4}){2,3}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\d)|(?<![\w.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\w\-])"
SSN = r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])"
CARD = r"(?<![\w\-])\d{4}(?:[ \-]?\d{4}){3}(?![\w\-])|(?<!\w)3[47]\d{2}[ \-]?\d{6}[ \-]?\d{5}(?!\w)"
SECRET = r"(?<![0-9A-Za-z])(?=[a-fA-F]*\d)(?=\d*[a-fA-F])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![0-9A-Za-z])|(?<!\w)(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}+)(?!\w)"
TITLE = "|".join(t for titles in TITLES.values() for t in titles)
#: Small words inside names, and words of names: with hyphens and apostrophes (not a genitive's), or initials before another word.
PARTICLE = "(?:af|al|av|bin|d[aeiou]|das|de la|de los|dei|del|della|dem|den|der|dos|du|el|ibn|la|le|ten|ter|van|von|y|zu|zum|zur)"
JOINED = r"(?:-\p{L}++|['’](?!s(?!\p{L}))\p{L}++)"
NAME = rf"(?:{PARTICLE} )*+(?:[dl]['’])?+(?:\p{{Lu}}\p{{L}}++{JOINED}*+|\p{{Lu}}{JOINED}++|\p{{Lu}}\.(?= \p{{Lu}}))"
PERSON = rf"(?<!\p{{L}})(?:{TITLE})\.? {NAME}(?: {NAME})*+(?!\p{{L}})"
#: In order of precedence.
KINDS = {"email": EMAIL, "ip": IP, "phone": PHONE, "ssn": SSN, "card": CARD, "secret": SECRET, "person": PERSON}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: Cheap necessary condition.
HINT = rf"\d|@|AKIA|gh[pousr]_|sk-|(?<!\p{{L}})(?:{TITLE})\.? \p{{L}}"

#: A family name with its small words, at the end of a name.
FAMILY = rf"(?:^| )((?:{PARTICLE} )*+\S+)$"
#: Draws after which numbers that still collide are permuted; mentions above one in so many are joined by a broadcast.
DRAWS, HEAVY = 12, 2000
NUMBERS = ("ip", "phone", "ssn", "card")
#: Rounds of the permutation.
ROUNDS = 8

DIGITS, LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"


def kind_of(raw: Column) -> Column:
    return reduce(lambda made, k: F.when(raw.rlike(f"^(?:{KINDS[k]})$"), F.lit(k)).otherwise(made), reversed(KINDS), F.lit("person"))


def chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def pick(options: Column | str, *salt: Column) -> Column:
    """One of a string's characters or an array's elements, by a hash."""
    if isinstance(options, str):
        return F.substring(F.lit(options), (F.pmod(F.xxhash64(*salt), F.lit(len(options))) + 1).cast("int"), F.lit(1))
    return F.element_at(options, (F.pmod(F.xxhash64(*salt), F.size(options)) + 1).cast("int"))


def scrambled(text: Column, seed: Column, letters: str = LETTERS, skip: int = 0) -> Column:
    """Digits for digits and small letters for small letters, from position ``skip`` on."""

    def one(c: Column, i: Column) -> Column:
        new = F.when(c.rlike("[0-9]"), pick(DIGITS, seed, i)).when(c.rlike("[a-z]"), pick(letters, seed, i)).otherwise(c)
        return F.when(i < skip, c).otherwise(new) if skip else new

    return F.array_join(F.transform(chars(text), one), "")


def luhn_rest(digits: Column) -> Column:
    """Luhn sum of a number that lacks its last digit, modulo 10."""
    twice = F.transform(F.reverse(chars(digits)), lambda c, i: F.when(i % 2 == 0, F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.try_cast("int") + 1)).otherwise(c.try_cast("int")))
    return F.aggregate(twice, F.lit(0), lambda a, x: (a + x) % 10)


def digest(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *[p.cast("string") for p in parts]), 256)


def draw(key: str) -> Column:
    """The surrogate of (kind, canon, tries, seed), in canonical form; the seed is a column, so that it isn't made for each character."""
    canon, tries, seed = F.col("canon"), F.col("tries"), F.col("seed")
    longer = F.when(tries >= 4, scrambled(F.repeat(F.lit("a"), tries - 3), digest(key, seed))).otherwise("")
    email = F.concat(scrambled(F.substring_index(canon, "@", 1), seed), longer, F.lit("@"), F.substring_index(canon, "@", -1))
    domain = F.concat(scrambled(F.regexp_replace(canon, r"\.[^.]*$", ""), seed), longer, F.regexp_extract(canon, r"\.[^.]*$", 0))
    ip = F.concat_ws(".", (F.pmod(F.xxhash64(seed, F.lit(0)), F.lit(223)) + 1).cast("string"), *[F.pmod(F.xxhash64(seed, F.lit(k)), F.lit(256)).cast("string") for k in (1, 2, 3)])
    secret = F.when(canon.rlike("^[0-9a-f]+$"), scrambled(canon, seed, "abcdef")).otherwise(_mixed(canon, seed))
    # canon of a given name: gender, script, name; of a family name: script, name
    parts = F.split(canon, "\\|")
    given, made = F.lit(None).cast("string"), F.lit(None).cast("string")
    for (script, gender), names in GIVEN.items():
        given = F.when((parts[0] == gender) & (parts[1] == script), pick(F.array(*map(F.lit, names)), seed, F.lit("g"))).otherwise(given)
    for script, syllables in SYLLABLES.items():
        # One more syllable for each repeated draw, so that there are always names left.
        options = F.array(*map(F.lit, syllables))
        name = F.array_join(F.transform(F.sequence(F.lit(0), F.least(tries, F.lit(9)) + 2), functools.partial(_syllable, options, seed)), "")
        made = F.when(F.element_at(parts, -2) == script, F.initcap(name)).otherwise(made)
    given = F.when(tries < 3, given).otherwise(made)
    kinds = {"email": email, "domain": domain, "ip": ip, "card": with_check(F.concat(F.substring(canon, 1, 1), scrambled(inner(canon), seed)), canon), "secret": secret, "given": given, "family": made}
    return reduce(lambda out, k: F.when(F.col("kind") == k, kinds[k]).otherwise(out), kinds, scrambled(canon, seed, skip=1))


def inner(number: Column) -> Column:
    """A card number without its first and last digit."""
    return F.substr(number, F.lit(2), F.length(number) - 2)


def with_check(body: Column, canon: Column) -> Column:
    """A number with the last digit that gives it the Luhn remainder of another one."""
    was = (luhn_rest(F.substr(canon, F.lit(1), F.length(canon) - 1)) + F.substr(canon, F.length(canon), F.lit(1)).try_cast("int")) % 10
    return F.concat(body, ((20 - luhn_rest(body) + was) % 10).cast("int").cast("string"))


def permuted(key: str) -> Column:
    """A number (kind, canon) through a permutation of its format: Feistel rounds over the two halves of what may change."""
    canon = F.col("canon")
    ip = F.aggregate(F.split(canon, "\\."), F.lit(0).cast("bigint"), lambda a, x: a * 256 + x.cast("bigint"))
    free = F.when(F.col("kind") == "card", inner(canon)).otherwise(F.substr(canon, F.lit(2), F.length(canon) - 1))
    left = F.floor(F.length(free) / 2).cast("int")
    tens = F.when(F.col("kind") == "ip", F.lit(0)).otherwise(left), F.when(F.col("kind") == "ip", F.lit(0)).otherwise(F.length(free) - left)
    sizes = [F.when(F.col("kind") == "ip", F.lit(65536)).otherwise(F.pow(F.lit(10), t)).cast("bigint") for t in tens]
    start = F.when(F.col("kind") == "ip", F.struct(F.floor(ip / 65536).alias("a"), (ip % 65536).alias("b")))
    start = start.otherwise(F.struct(F.substr(free, F.lit(1), left).try_cast("bigint").alias("a"), F.substr(free, left + 1, F.length(free) - left).try_cast("bigint").alias("b")))

    def turn(halves: Column, k: Column) -> Column:
        drawn = F.conv(F.substring(digest(key, F.lit("turn"), F.col("kind"), F.length(canon), F.substring(canon, 1, 1), k, halves["b"]), 1, 12), 16, 10).cast("bigint")
        own = F.when(k % 2 == 0, sizes[0]).otherwise(sizes[1])
        return F.struct(halves["b"].alias("a"), F.pmod(halves["a"] + drawn, own).alias("b"))

    end = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)
    octets = [F.floor(end["a"] / 256), end["a"] % 256, F.floor(end["b"] / 256), end["b"] % 256]
    digits = F.concat(F.substring(canon, 1, 1), F.lpad(end["a"].cast("string"), left, "0"), F.lpad(end["b"].cast("string"), F.length(free) - left, "0"))
    return F.when(F.col("kind") == "ip", F.concat_ws(".", *[o.cast("string") for o in octets])).when(F.col("kind") == "card", with_check(digits, canon)).otherwise(digits)


def _syllable(options: Column, seed: Column, i: Column) -> Column:
    return pick(options, seed, i)


def _mixed(text: Column, seed: Column) -> Column:
    """Letters keep their case; the leading letters of a key's shape stay."""
    head = F.regexp_extract(text, "^(?:AKIA|gh[pousr]_|sk-)", 0)
    new = F.transform(chars(text), lambda c, i: F.when(i < F.length(head), c).when(c.rlike("[0-9]"), pick(DIGITS, seed, i)).when(c.rlike("[a-z]"), pick(LETTERS, seed, i)).when(c.rlike("[A-Z]"), pick(LETTERS.upper(), seed, i)).otherwise(c))
    return F.array_join(new, "")


def units(kind: Column, raw: Column) -> Column:
    """What an entity is made of, as an array of (kind, canon); canon is what all spellings of a unit share."""
    title, name = F.regexp_extract(raw, rf"^({TITLE})\.? ", 1), F.regexp_replace(raw, rf"^(?:{TITLE})\.? ", "")
    gender = F.when(title.isin(*TITLES["m"]), "m").otherwise("f")
    script = F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    family, given = F.regexp_extract(name, FAMILY, 1), F.regexp_replace(name, FAMILY, "")
    plain = F.when(raw.rlike("^[0-9a-fA-F]+$"), F.lower(raw)).otherwise(raw)

    def unit(kind: Column | str, canon: Column) -> Column:
        return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), canon.alias("canon"))

    last = unit("family", F.concat_ws("|", script, F.lower(family)))
    person = F.when(given == "", F.array(last)).otherwise(F.array(unit("given", F.concat_ws("|", gender, script, F.lower(given))), last))
    email = F.array(unit("email", F.lower(raw)), unit("domain", F.lower(F.substring_index(raw, "@", -1))))
    other = F.when(kind == "ip", raw).when(kind == "secret", plain).otherwise(F.regexp_replace(raw, r"\D", ""))
    return F.when(kind == "email", email).when(kind == "person", person).otherwise(F.array(unit(kind, other)))


def written(kind: Column, raw: Column, made: Column) -> Column:
    """The surrogates of an entity's units in the spelling of the mention: capitals, spaces and punctuation of ``raw``."""
    surrogate = F.element_at(made, 1)
    digits = F.transform(F.sequence(F.lit(1), F.length(raw)), lambda i: F.when(F.substr(raw, i, F.lit(1)).rlike("[0-9]"), F.substr(surrogate, F.length(F.regexp_replace(F.substr(raw, F.lit(1), i), r"\D", "")), F.lit(1))).otherwise(F.substr(raw, i, F.lit(1))))
    surrogate = F.when(kind == "email", F.concat(F.substring_index(surrogate, "@", 1), F.lit("@"), F.element_at(made, -1))).otherwise(surrogate)
    cased = F.when(raw.rlike("[A-Za-z]") & (raw == F.upper(raw)), F.upper(surrogate)).otherwise(surrogate)
    title, name = F.regexp_extract(raw, rf"^(?:{TITLE})\.? ", 0), F.regexp_replace(raw, rf"^(?:{TITLE})\.? ", "")
    joined = F.array_join(made, " ")
    person = F.concat(title, F.when((name == F.upper(name)) & (F.length(name) > 1), F.upper(joined)).otherwise(joined))
    return F.when(kind.isin("phone", "card", "ssn"), F.array_join(digits, "")).when(kind == "person", person).otherwise(cased)


def untitled(kind: Column, raw: Column, made: Column) -> Column:
    """Forms of a name without its title, with what stands for each: the whole name and the family name."""
    name = F.regexp_replace(raw, rf"^(?:{TITLE})\.? ", "")
    whole = F.struct(name.alias("old"), F.array_join(made, " ").alias("new"))
    last = F.struct(F.regexp_extract(name, FAMILY, 1).alias("old"), F.element_at(made, -1).alias("new"))
    return F.when(kind == "person", F.filter(F.array(whole, last), lambda x: F.length(x["old"]) > 2)).otherwise(F.array().cast("array<struct<old:string,new:string>>"))


def surrogates(entities: DataFrame, scratch: Scratch, key: str, draws: int = DRAWS) -> DataFrame:
    """``entities(kind, canon)``, distinct, with ``surrogate``: distinct within a kind and, but for permuted numbers, no unit itself."""
    low = F.lower(F.element_at(F.split("canon", "\\|"), -1))
    originals = scratch.save(entities.select("kind", low.alias("low")).distinct().withColumn("clash", F.lit(True)))
    settled, open_, tries = None, entities.select("kind", "canon", F.lit(1).alias("new")), 0
    while True:
        drawn = scratch.save(open_.withColumn("tries", F.lit(tries)).withColumn("seed", digest(key, F.col("kind"), F.col("canon"), F.col("tries"))).select("kind", "canon", "new", draw(key).alias("surrogate")))
        every = drawn if settled is None else drawn.unionByName(settled)
        # What is settled stays; among new units with one surrogate the first in order gets it.
        holders = every.groupBy("kind", "surrogate").agg(F.min(F.struct("new", "canon")).alias("holder"))
        judged = drawn.join(holders, ["kind", "surrogate"]).withColumn("low", F.lower("surrogate")).join(originals, ["kind", "low"], "left")
        again = F.coalesce("clash", F.lit(False)) | (F.col("holder.canon") != F.col("canon"))
        judged = scratch.save(judged.select("kind", "canon", "surrogate", again.alias("again")))
        good = judged.filter("not again").select("kind", "canon", F.lit(0).alias("new"), "surrogate")
        settled = good if settled is None else scratch.save(settled.unionByName(good))
        open_ = judged.filter("again").select("kind", "canon", F.lit(1).alias("new"))
        tries += 1
        if tries == draws and (stuck := open_.filter(F.col("kind").isin(*NUMBERS))).limit(1).count():
            form = [F.col("kind"), F.when(F.col("kind") == "ip", F.lit("")).otherwise(F.concat(F.length("canon"), F.substring("canon", 1, 1))).alias("form")]
            full = scratch.save(stuck.select(*form).distinct())
            whole = entities.select("kind", "canon", form[1]).join(full, ["kind", "form"]).select("kind", "canon")
            whole = scratch.save(whole.select("kind", "canon", F.lit(0).alias("new"), permuted(key).alias("surrogate")))
            rest = settled.withColumn("form", form[1]).join(full, ["kind", "form"], "left_anti").select("kind", "canon", "new", "surrogate")
            settled = scratch.save(rest.unionByName(whole))
            open_ = open_.filter(~F.col("kind").isin(*NUMBERS))
        if not open_.limit(1).count():
            return settled.select("kind", "canon", "surrogate")


def mentions(docs: DataFrame) -> DataFrame:
    """(doc_id, row, pos, raw, kind) of every entity in the texts; ``row`` is the XXH64 of the text."""
    some = docs.filter(F.col("text").rlike(HINT)).select("doc_id", F.xxhash64("text").alias("row"), F.regexp_extract_all("text", F.lit(ANY), F.lit(0)).alias("found"))
    return some.select("doc_id", "row", F.posexplode("found").alias("pos", "raw")).distinct().withColumn("kind", kind_of(F.col("raw")))


def replace(docs: DataFrame, key: str = KEY) -> DataFrame:
    """(doc_id, text, n_entities) of every document, with surrogates in the place of personal data."""
    scratch = Scratch(docs.sparkSession, "pii")
    read = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = scratch.save(mentions(read))
    kind, raw = F.col("kind"), F.col("raw")
    spelled = scratch.save(found.groupBy("kind", "raw").agg(F.count("*").alias("n")).withColumn("units", units(kind, raw)))
    drawn = surrogates(spelled.select(F.explode("units").alias("u")).select("u.*").distinct(), scratch, key)
    each = spelled.select("kind", "raw", "n", F.posexplode("units").alias("at", "u")).select(raw, "n", "at", kind.alias("whole"), "u.kind", "u.canon")
    made = each.join(drawn, ["kind", "canon"]).groupBy(F.col("whole").alias("kind"), "raw", "n").agg(F.array_sort(F.collect_list(F.struct("at", "surrogate"))).alias("made"))
    made = made.withColumn("made", F.transform("made", lambda x: x["surrogate"]))
    new = scratch.save(made.select("kind", "raw", "n", written(kind, raw, F.col("made")).alias("new"), untitled(kind, raw, F.col("made")).alias("names")))
    # Fewer than HEAVY entities have that many mentions each; all others are shuffled.
    often = F.lit((new.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // HEAVY)
    told = found.join(F.broadcast(new.filter(F.col("n") > often)), ["raw", "kind"]).unionByName(found.join(new.filter(F.col("n") <= often), ["raw", "kind"]))
    by_doc = told.groupBy("doc_id", "row").agg(F.collect_list(F.struct("pos", "new")).alias("all"), F.flatten(F.collect_set("names")).alias("names"))
    names = F.array_sort(F.array_distinct("names"), lambda a, b: F.when(F.length(a["old"]) != F.length(b["old"]), F.length(b["old"]) - F.length(a["old"])).when(a["old"] < b["old"], -1).when(a["old"] > b["old"], 1).otherwise(0))
    by_doc = by_doc.select(F.col("doc_id").alias("of"), F.col("row").alias("of_row"), F.transform(F.array_sort("all"), lambda x: x["new"]).alias("news"), names.alias("names"))
    by_doc = scratch.save(by_doc)
    hinted = F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    touched = read.filter(hinted)
    joined = touched.join(by_doc, F.col("doc_id").eqNullSafe(F.col("of")) & (F.xxhash64("text") == F.col("of_row")), "left")
    between = F.split(F.col("text"), ANY, -1)
    # Long names come first, and no surrogate is a name of the corpus, so that nothing is replaced twice.
    bare = F.transform(between, lambda part: F.aggregate("names", part, lambda t, x: F.regexp_replace(t, F.concat(F.lit(r"(?<![\p{L}'’\-])\Q"), x["old"], F.lit(r"\E(?![\p{L}\-])")), x["new"])))
    between = F.when(F.size("names") > 0, bare).otherwise(between)
    text = F.when(F.col("news").isNull(), F.col("text")).otherwise(F.array_join(F.zip_with(between, "news", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""))
    out = joined.select("doc_id", text.alias("text"), F.coalesce(F.size("news"), F.lit(0)).alias("n_entities"))
    return out.unionByName(read.filter(~hinted).select("doc_id", "text", F.lit(0).alias("n_entities")))
