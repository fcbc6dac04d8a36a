"""Personal data replaced by surrogates of the same kind, form, script and gender.

One pattern finds every entity of a text. An entity is known by its canonical form (digits
of a phone or card number, lower case of a name or address), so all its spellings in all
documents get one surrogate: a keyed SHA-512 stream fills the entity's form. Surrogates
are proposed for all entities of the corpus at once and checked for collisions by joins:
one that equals another's, or equals some entity that really occurs, is proposed anew.
Nothing but SQL functions runs on the texts.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stored

#: Titles that tell a person's name, by gender.
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Госпожа"),
    "m": ("Mr", "Herr", "Señor", "Monsieur", "Господин"),
    "x": ("Dr", "Prof"),
}
TITLE = "|".join(t for titles in TITLES.values() for t in titles)
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Also with hyphens, apostrophes and inner capitals, but without the 's of a genitive.
NAME = r"\p{Lu}(?:[\p{L}\p{M}]++|(?=['’-]\p{L}))(?:['’-](?!s(?![\p{L}\p{M}]))[\p{L}\p{M}]++)*+"
#: Characters of the local part of an e-mail address.
LOCAL = r"[A-Za-z0-9._%+-]"
#: Forms that are found first and that digits in groups stop at. Java's matcher recurses for
#: each turn of a repeated group, so what repeats without bound is one class of characters or
#: possessive, and a run is entered at its start only, or where the last match ended.
FORMS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@(?=[A-Za-z0-9-])[A-Za-z0-9.-]*(?<!\.)\.[A-Za-z]{{2,}}",
    "ip": rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])",
    "phone": r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"
    r"|(?<![0-9])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Not replaced, but no part of a card number either.
DATE = (
    r"(?<![0-9])(?<![0-9]-)(?:[0-9]{4}[-/.](?:0?[1-9]|1[0-2])[-/.](?:[12][0-9]|3[01]|0?[1-9])"
    r"|(?:[12][0-9]|3[01]|0?[1-9])[-/.](?:[12][0-9]|3[01]|0?[1-9])[-/.][0-9]{4})(?![0-9]|-[0-9])"
)
FORM = "|".join(f"(?:{p})" for p in (*FORMS.values(), DATE))
#: Kinds in the order in which they are tried at a place, with their patterns. ``card`` is
#: a whole run of digits in groups, in which ``card_pieces`` looks for the numbers.
KINDS = FORMS | {
    "date": DATE,
    "card": rf"(?<![0-9+])(?=(?:[0-9][ -]?){{13}})[0-9]++(?:[ -](?!{FORM})[0-9]++)*+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![A-Za-z0-9])",
    "key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "secret": r"(?:password|passwd|secret|token|api_key) ?[=:] ?\"?(?=[+/_.-]*[A-Za-z0-9])[A-Za-z0-9+/_.-]{8,}",
    "person": rf"(?<![\p{{L}}])(?:{TITLE})\.? {NAME}(?: {NAME})?(?![\p{{L}}\p{{M}}])",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: A text without any of these holds no entity; spares most texts the long pattern.
HINT = rf"[0-9@]|AKIA|(?:password|passwd|secret|token|api_key) ?[=:]|(?:{TITLE})\.? "
#: Digits of each group of a card number, by the letter that marks its first group.
CARDS = {
    "a": r"[0-9]{4}(?:[ -][0-9]{4}){3}[ -][0-9]{3}",
    "b": r"[0-9]{4}(?:[ -][0-9]{4}){3}",
    "c": r"[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}",
    "d": r"[0-9]{13,19}",
}
#: The numbers of a run with marks, else 13 to 19 digits in any groups without a mark.
MARKED = (
    r"a[0-9]+(?:[ -][a-d]?[0-9]+){4}|b[0-9]+(?:[ -][a-d]?[0-9]+){3}|c[0-9]+(?:[ -][a-d]?[0-9]+){2}|d[0-9]+"
    r"|(?<![0-9a-d])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
)
#: Letters and digits of the scripts that are kept, each filled from itself.
ALPHABETS = (
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "абвгдежзиклмнопрстуфхцчшэюя",
    "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ",
    "αβγδεζηθικλμνξοπρστυφχψω",
    "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
)
#: Characters that one hash fills.
BLOCK = 64
#: Parts of the table of a text's entities, which is searched from its start.
SLOTS = 256
#: So many surrogates of the very form are proposed for an entity; later ones are longer.
SAME_FORM = 3
#: Consonants, vowels and the endings of given names by gender, for Latin and Cyrillic.
SYLLABLES = {
    "latin": ("bdfgklmnprstvz", "aeiou", {"f": "a", "m": "n", "x": "e"}),
    "cyrillic": ("бвгдзклмнпрст", "аеиоу", {"f": "а", "m": "н", "x": "е"}),
}


def luhn_sum(digits: Column) -> Column:
    """Sum of the digits, every second one from the right doubled; 0 mod 10 for a card."""
    places = F.reverse(F.split(digits, ""))

    def value(d: Column, i: Column) -> Column:
        doubled = d.cast("int") * 2
        return F.when(i % 2 == 0, d.cast("int")).when(doubled > 9, doubled - 9).otherwise(doubled)

    return F.aggregate(F.transform(places, value), F.lit(0), lambda a, b: a + b)


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def kind_of(surface: Column) -> Column:
    """The kind of a match, null for a date."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(KINDS.items()):
        whole = surface.rlike(rf"\A(?:{pattern})\z")
        out = F.when(whole, F.lit(None) if kind == "date" else F.lit(kind)).otherwise(out)
    return out


def card_pieces(run: Column) -> Column:
    """array<struct<piece, is>>: a run of digits in groups, cut before and after each card
    number in it; ``is`` is ``card`` or null.

    Each group is tried as the first one of a number in the usual groups; the first that
    has a right check digit takes its groups. What is left is tried in any groups.
    """

    def marks(split: Column) -> Column:
        def marked(group: Column, i: Column) -> Column:
            mark = F.lit("")
            for letter, n in (("d", 1), ("c", 3), ("b", 4), ("a", 5)):
                number = F.array_join(F.slice(split["groups"], i + 1, F.lit(n)), "-")
                right = number.rlike(rf"\A(?:{CARDS[letter]})\z") & (luhn_sum(digits_of(number)) % 10 == 0)
                mark = F.when(right, letter).otherwise(mark)
            return F.concat(F.get(split["gaps"], i), mark, group)

        return F.array_join(F.transform(split["groups"], marked), "")

    def piece(part: Column, card: Column) -> Column:
        return F.struct(F.regexp_replace(part, "[a-d]", "").alias("piece"), F.when(card, "card").alias("is"))

    def pieces(cut: Column) -> Column:
        def both(number: Column, i: Column) -> Column:
            right = luhn_sum(digits_of(number)) % 10 == 0
            return F.array(piece(F.get(cut["between"], i), F.lit(False)), piece(number, right))

        last = F.array(piece(F.element_at(cut["between"], -1), F.lit(False)))
        return F.concat(F.flatten(F.transform(cut["numbers"], both)), last)

    split = F.struct(F.split(run, "[ -]").alias("groups"), F.split(run, "[0-9]+").alias("gaps"))
    found = bound(
        bound(split, marks),
        lambda m: F.struct(F.regexp_extract_all(m, F.lit(MARKED), F.lit(0)).alias("numbers"), F.split(m, MARKED, -1).alias("between")),
    )
    return bound(found, pieces)


@dataclass(frozen=True)
class _Noise:
    """Numbers 0 to 255 from a column of hexadecimal digits."""

    hexadecimal: Column

    def at(self, i) -> Column:
        place = (F.lit(i) if isinstance(i, int) else i) * 2 + 1
        return F.conv(self.hexadecimal.substr(place, F.lit(2)), 16, 10).cast("int")


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, not for each element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def filled(form: Column, seed: Column) -> Column:
    """``form`` with its letters and digits drawn anew, each from its own alphabet.

    ``BLOCK`` characters share a hash, so a long form costs no more for each character
    than a short one.
    """

    def block(text: Column, n: Column) -> Column:
        def draw(noise: Column) -> Column:
            def drawn(c: Column, i: Column) -> Column:
                out = c
                for letters in ALPHABETS:
                    new = F.lit(letters).substr(_Noise(noise).at(i) % len(letters) + 1, F.lit(1))
                    out = F.when(F.instr(F.lit(letters), c) > 0, new).otherwise(out)
                return out

            return F.array_join(F.transform(F.split(text, ""), drawn), "")

        return bound(F.sha2(F.concat_ws("\x1f", seed, n.cast("string")), 512), draw)

    return F.array_join(F.transform(F.regexp_extract_all(form, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0)), block), "")


def spoken(noise: _Noise, script: str, syllables: Column, ending: str) -> Column:
    """A name of so many syllables with a capital letter."""
    consonants, vowels, _ = SYLLABLES[script]

    def syllable(i: Column) -> Column:
        first = F.lit(consonants).substr(noise.at(i * 2) % len(consonants) + 1, F.lit(1))
        return F.concat(first, F.lit(vowels).substr(noise.at(i * 2 + 1) % len(vowels) + 1, F.lit(1)))

    name = F.array_join(F.transform(F.sequence(F.lit(0), syllables - 1), syllable), "")
    return F.initcap(F.concat(name, F.lit(ending)))


def entity_parts(surface: Column, kind: Column) -> Column:
    """array<struct<kind, canon, gender>>: one entity, or the given and the family name.

    ``gender`` is that of the title before a given name, else null.
    """

    def one(name, canon):
        return F.array(F.struct(F.lit(name).alias("kind"), canon.alias("canon"), F.lit(None).cast("string").alias("gender")))

    digits = digits_of(surface)
    parts = F.when(kind == "email", one("email", F.lower(surface)))
    parts = parts.when(kind == "ip", one("ip", surface))
    parts = parts.when(kind == "card", one("card", digits)).when(kind == "ssn", one("ssn", digits))
    parts = parts.when(kind == "phone", one("phone", F.concat(F.when(surface.startswith("+"), "+").otherwise(""), digits)))
    parts = parts.when(kind == "iban", one("iban", F.translate(surface, " ", ""))).when(kind == "key", one("key", surface))
    parts = parts.when(kind == "secret", one("secret", F.regexp_extract(surface, r"[A-Za-z0-9+/_.-]+\z", 0)))
    title, names = F.regexp_extract(surface, rf"\A(?:{TITLE})", 0), F.split(surface, " ")
    gender = F.when(title.isin(*TITLES["f"]), "f").when(title.isin(*TITLES["m"]), "m").otherwise("x")
    given = F.struct(F.lit("given").alias("kind"), F.lower(F.get(names, F.lit(1))).alias("canon"), gender.alias("gender"))
    no_gender = F.lit(None).cast("string").alias("gender")
    family = F.struct(F.lit("family").alias("kind"), F.lower(F.element_at(names, -1)).alias("canon"), no_gender)
    person = F.when(F.size(names) > 2, F.array(given, family)).otherwise(F.array(family))
    return parts.when(kind == "person", person)


def with_gender(parts: DataFrame) -> DataFrame:
    """``parts`` with one kind given_f, given_m or given_x for all of a given name.

    The titles before it in all documents decide, those of either gender by their number.
    """
    n_f, n_m = F.count(F.when(F.col("gender") == "f", 1)), F.count(F.when(F.col("gender") == "m", 1))
    gender = F.when(n_f > n_m, "f").when(n_m > n_f, "m").otherwise("x")
    genders = parts.where("kind = 'given'").groupBy("kind", "canon").agg(gender.alias("settled"))
    kind = F.when(F.col("kind") == "given", F.concat(F.lit("given_"), "settled")).otherwise(F.col("kind"))
    return parts.join(genders, ["kind", "canon"], "left").withColumn("kind", kind).drop("settled", "gender")


def proposal(key: str, attempt: int) -> Column:
    """The surrogate proposed for (kind, canon), in canonical form.

    From attempt ``SAME_FORM`` on it has one place more with each attempt, so that a form
    with few or no free places does not run out.
    """
    kind, entity = F.col("kind"), F.col("canon")
    more = max(0, attempt - SAME_FORM + 1)
    blocks = F.sequence(F.lit(0), F.lit((more + 2 * attempt) // 32 + 1))
    seed = F.concat_ws("\x1f", F.lit(key), kind, entity, F.lit(str(attempt)))
    stream = F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat_ws("\x1f", seed, b.cast("string")), 512)), "")
    noise, digest = _Noise(F.col("noise")), F.col("noise").substr(1, 128)
    grown = F.when(kind.isin("secret", "key"), "a" * more).otherwise("0" * more)
    canon = F.concat(entity, grown) if more else entity
    local, label = F.concat(F.substring_index(entity, "@", 1), F.lit("a" * more)), F.regexp_extract(entity, r"@([^.]+)", 1)
    top = F.lit("comnetorg").substr(noise.at(0) % 3 * 3 + 1, F.lit(3))
    # Names below example.com, .net and .org belong to nobody.
    email = F.concat(filled(local, digest), F.lit("@"), filled(label, F.concat(digest, F.lit("@"))), F.lit(".example."), top)
    octets = [noise.at(i).cast("string") for i in range(1, 4 + more)]
    ip = F.concat_ws(".", (noise.at(0) % 223 + 1).cast("string"), *octets)
    rest = canon.substr(F.lit(2), F.length(canon))
    body = F.concat(F.substring(canon, 1, 1), filled(canon.substr(F.lit(2), F.length(canon) - 2), digest))
    card = F.concat(body, ((10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))
    number = F.length(F.ltrim(canon, F.lit("+")))
    code = F.length(canon) - F.when(canon.startswith("+") & (number > 10), 10 + more).otherwise(number - 1)
    lead = F.substring(F.lit("23456789"), 1, 8).substr(noise.at(0) % 8 + 1, F.lit(1))
    phone = F.concat(canon.substr(F.lit(1), code), lead, filled(canon.substr(code + 2, F.length(canon)), digest))
    out = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", phone)
    # Areas from 900 on are given to nobody.
    out = out.when(kind == "ssn", F.concat(F.lit("9"), filled(rest, digest)))
    out = out.when(kind == "key", F.concat(F.substring(canon, 1, 4), filled(canon.substr(F.lit(5), F.length(canon)), digest)))
    out = out.when(kind == "iban", F.concat(F.substring(canon, 1, 2), filled(canon.substr(F.lit(3), F.length(canon)), digest)))
    out = out.when(kind == "secret", filled(canon, digest))
    for script, (_, _, endings) in SYLLABLES.items():
        # Each further attempt has one syllable more, so there are always names left.
        fits = entity.rlike(r"\p{IsCyrillic}") if script == "cyrillic" else F.lit(True)
        out_names = F.when(kind == "family", spoken(noise, script, F.lit(3 + attempt), ""))
        for gender, ending in endings.items():
            out_names = out_names.when(kind == f"given_{gender}", spoken(noise, script, F.lit(2 + attempt), ending))
        names = out_names if script == "latin" else F.when(fits, out_names).otherwise(names)
    return stream, F.coalesce(out, names)


def assign_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """kind, canon, surrogate: different for different entities, and none of them real.

    Each round proposes a surrogate for every open entity. A proposal is accepted if no
    entity of its kind has it as its own form, no accepted surrogate is equal, and of
    equal proposals it belongs to the smallest entity. Names grow with each round and all
    other forms from round ``SAME_FORM`` on, so no kind runs out of free surrogates.
    """
    entities = stored(entities.select("kind", "canon").distinct())
    real = entities.select("kind", F.col("canon").alias("surrogate"))
    opened, done, attempt = entities, None, 0
    while not opened.isEmpty():
        stream, surrogate = proposal(key, attempt)
        proposed = opened.withColumn("noise", stream).select("kind", "canon", surrogate.alias("surrogate"))
        lowered = F.when(F.col("kind").startswith("given_") | (F.col("kind") == "family"), F.lower("surrogate")).otherwise(F.col("surrogate"))
        proposed = proposed.withColumn("plain", lowered)
        free = proposed.join(real, (proposed["kind"] == real["kind"]) & (proposed["plain"] == real["surrogate"]), "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = free.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon")).select("kind", "canon", "surrogate")
        done = stored(won if done is None else done.union(won))
        opened = stored(entities.join(done, ["kind", "canon"], "left_anti"))
        attempt += 1
    if done is None:
        return entities.withColumn("surrogate", F.col("canon"))
    return done


def poured(surface: Column, digits: Column) -> Column:
    """``surface`` with its letters and digits replaced one by one by those of ``digits``;
    what ``digits`` has beyond them follows."""

    def place(c: Column, i: Column) -> Column:
        before = F.length(F.regexp_replace(surface.substr(F.lit(1), i), "[^0-9A-Za-z]", ""))
        return F.when(c.rlike("[0-9A-Za-z]"), digits.substr(before + 1, F.lit(1))).otherwise(c)

    places = F.length(F.regexp_replace(surface, "[^0-9A-Za-z]", ""))
    return F.concat(F.array_join(F.transform(F.split(surface, ""), place), ""), digits.substr(places + 1, F.length(digits)))


def worn(name: Column, surrogate: Column) -> Column:
    """The surrogate of a name, in capitals like the name."""
    capitals = (name == F.upper(name)) & (F.length(name) > 1)
    return F.when(capitals, F.upper(surrogate)).otherwise(surrogate)


def slot(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(SLOTS))


def table_of(rows: DataFrame, name: str, value: str, out: str) -> DataFrame:
    """doc_id, pii__mark, and ``out``: a map by slot of maps from ``name`` to ``value``."""
    own = rows.withColumn("slot", slot(F.col(name))).groupBy("doc_id", "pii__mark", "slot")
    own = own.agg(F.map_from_entries(F.collect_list(F.struct(name, value))).alias("own"))
    whole = F.map_from_entries(F.collect_list(F.struct("slot", "own")))
    return own.groupBy("doc_id", "pii__mark").agg(whole.alias(out))


def looked_up(table: str, name: Column) -> Column:
    return F.try_element_at(F.try_element_at(table, slot(name)), name)


def with_mentions(named: DataFrame) -> DataFrame:
    """doc_id, pii__mark, and of the names found in this text: pii__pattern, which matches
    them or what ``PATTERN`` does, and pii__names, their surrogates by lower case.

    A word that is a given and a family name counts as the given one. The pattern branches
    by the first and second letter, so that a place is compared with few of many names.
    """
    key = ["doc_id", "pii__mark"]
    names = named.where("is = 'person'").withColumn("name", F.get(F.split("piece", " "), F.col("part") + F.size(F.split("piece", " ")) - F.col("n_parts")))
    names = names.groupBy(*key, "canon").agg(F.collect_set("name").alias("names"), F.max_by("surrogate", "kind").alias("surrogate"))
    words = names.select(*key, F.explode("names").alias("name"))
    letters = {f"letter{i}": F.lower(F.substring("name", i, 1)) for i in (1, 2)}
    words = words.withColumns(letters | {"one": F.substring("name", 1, 1), "two": F.substring("name", 2, 1)})
    words = words.withColumn("rest", F.expr("substring(name, 3)"))

    def either(first: str, then: str) -> Column:
        """Longer alternatives first; names hold no signs of patterns."""
        every = F.collect_set(F.struct(F.length(then).alias("n"), F.col(then).alias("of")))
        ways = F.array_join(F.transform(F.reverse(F.array_sort(every)), lambda w: w["of"]), "|")
        return F.concat(F.min(first), F.lit("(?:"), ways, F.lit(")"))

    ways = words.groupBy(*key, "letter1", "letter2").agg(F.min("one").alias("one"), either("two", "rest").alias("way"))
    # A name of one letter has no second one: it comes after those that begin with it.
    last = F.when(F.col("letter2") == "", 0).otherwise(1).alias("n")
    ways = ways.groupBy(*key, "letter1").agg(
        F.concat(F.min("one"), F.lit("(?:"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(last, "way")), False), lambda w: w["way"]), "|"), F.lit(")")).alias("way")
    )
    ways = ways.groupBy(*key).agg(F.array_join(F.collect_list("way"), "|").alias("ways"))
    edge = r"[\p{L}\p{M}\p{N}_]"
    mention = F.concat(F.lit(rf"|(?<!{edge})(?=\p{{Lu}})(?iu:"), "ways", F.lit(rf")(?!{edge})"))
    pattern = ways.select(F.col("doc_id").alias("of"), F.col("pii__mark").alias("same"), F.concat(F.lit(PATTERN), mention).alias("pii__pattern"))
    held = table_of(names, "canon", "surrogate", "pii__names")
    met = held.join(pattern, held["doc_id"].eqNullSafe(pattern["of"]) & (held["pii__mark"] == pattern["same"]))
    return met.select("doc_id", "pii__mark", "pii__pattern", "pii__names")


def replacement(surface: Column, kind: Column, parts: Column) -> Column:
    """The text that takes the place of a match; ``parts`` are its surrogates in order."""
    one = F.get(parts, F.lit(0))
    shown = F.when(surface == F.upper(surface), F.upper(one)).otherwise(one)
    out = F.when(kind == "email", shown).when(kind.isin("ip", "key"), one)
    out = out.when(kind.isin("card", "ssn", "iban"), poured(surface, one)).when(kind == "phone", poured(surface, digits_of(one)))
    out = out.when(kind == "secret", F.concat(F.regexp_extract(surface, r"\A(.*?)[A-Za-z0-9+/_.-]+\z", 1), one))
    title = F.substring_index(surface, " ", 1)
    names = F.slice(F.split(surface, " "), 2, 2)
    shown = F.transform(parts, lambda p, i: worn(F.get(names, i), p))
    return out.when(kind == "person", F.concat_ws(" ", title, F.array_join(shown, " ")))


def replace_personal_data(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with surrogates in ``text``, and n_replaced, how many places of it changed.

    Found are e-mail and IPv4 addresses, card numbers (check digit holds; also between other
    groups of digits), phone numbers,
    US social security numbers, IBANs, access keys, values of ``password=`` and the like,
    and names after a title, which are then replaced wherever else they are in the same
    text as whole words with a capital. The titles before a given name in all documents
    decide the gender of its surrogate. A surrogate has the kind
    and the form of what it replaces; equal entities get equal surrogates in all
    documents, different ones different surrogates, and no surrogate occurs as an entity
    in the input. Who has ``key`` and an entity can tell its surrogate, not the reverse.

    Null texts stay null and empty ones empty, with n_replaced 0. Rows are kept as they
    are, repeated ones, null doc_ids and other columns too; a column n_replaced of the
    input gives way. An empty table gives an empty result. Texts without an entity are
    not shuffled.
    """
    docs = docs.drop("n_replaced")
    text = F.col("text")
    found = F.coalesce(text.rlike(HINT) & text.rlike(PATTERN), F.lit(False))
    docs = docs.withColumn("pii__found", found)
    held = docs.where("pii__found").withColumn("pii__mark", F.xxhash64("text"))
    matches = F.array_distinct(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)))
    surfaces = held.select("doc_id", "pii__mark", F.explode(matches).alias("surface"))
    surfaces = surfaces.distinct().withColumn("is", kind_of(F.col("surface"))).where(F.col("is").isNotNull())
    whole = F.array(F.struct(F.col("surface").alias("piece"), F.col("is")))
    cut = F.when(F.col("is") == "card", card_pieces(F.col("surface"))).otherwise(whole)
    surfaces = surfaces.withColumn("pieces", cut).where(F.exists("pieces", lambda p: p["is"].isNotNull()))
    pieces = surfaces.select("doc_id", "pii__mark", "surface", F.posexplode("pieces").alias("place", "p"))
    pieces = pieces.select("doc_id", "pii__mark", "surface", "place", "p.piece", "p.is")
    # A piece between card numbers has one part without an entity.
    none = F.array(F.lit(None).cast("struct<kind: string, canon: string, gender: string>"))
    each = F.coalesce(entity_parts(F.col("piece"), F.col("is")), none)
    parts = pieces.withColumns({"each": each, "n_parts": F.size(each)})
    parts = parts.select("*", F.posexplode("each").alias("part", "entity")).select("*", "entity.*").drop("each", "entity")
    parts = stored(with_gender(stored(parts)))
    surrogates = assign_surrogates(parts.where("kind is not null"), key)
    keys = ["doc_id", "pii__mark", "surface"]
    named = stored(parts.join(surrogates, ["kind", "canon"], "left"))
    whole = named.groupBy(*keys, "place", "piece", "is").agg(
        F.array_sort(F.collect_list(F.struct("part", "surrogate"))).alias("parts")
    )
    new = replacement(F.col("piece"), F.col("is"), F.transform("parts", lambda p: p["surrogate"]))
    put = whole.withColumn("new", F.when(F.col("is").isNull(), F.col("piece")).otherwise(new))
    put = put.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("place", "new"))).alias("put"), F.count("is").cast("int").alias("n")
    )
    put = put.withColumn("put", F.struct(F.array_join(F.transform("put", lambda p: p["new"]), "").alias("new"), "n"))
    by_text = table_of(put, "surface", "put", "pii__map")
    both = by_text["doc_id"].eqNullSafe(F.col("m.doc_id")) & (by_text["pii__mark"] == F.col("m.pii__mark"))
    by_text = by_text.join(with_mentions(named).alias("m"), both, "left").select(
        by_text["doc_id"].alias("pii__id"), by_text["pii__mark"].alias("pii__same"), "pii__map", "pii__pattern", "pii__names"
    )
    same = held["doc_id"].eqNullSafe(by_text["pii__id"]) & (held["pii__mark"] == by_text["pii__same"])
    held = held.join(by_text, same, "left").withColumn("pii__pattern", F.coalesce("pii__pattern", F.lit(PATTERN)))
    held = held.withColumns(
        {"pii__matches": F.regexp_extract_all("text", "pii__pattern", F.lit(0)), "pii__between": F.split("text", F.col("pii__pattern"), -1)}
    )

    def mentioned(m: Column) -> Column:
        return worn(m, looked_up("pii__names", F.lower(m)))

    put = F.transform(
        "pii__matches",
        lambda m, i: F.concat(F.get("pii__between", i), F.coalesce(looked_up("pii__map", m)["new"], mentioned(m), m)),
    )
    places = F.transform("pii__matches", lambda m: F.coalesce(looked_up("pii__map", m)["n"], mentioned(m).isNotNull().cast("int")))
    changed = F.aggregate(places, F.lit(0), lambda a, b: a + b)
    held = held.withColumn("text", F.concat(F.array_join(put, ""), F.element_at("pii__between", -1)))
    names = [c for c in docs.columns if c != "pii__found"]
    clean = docs.where("not pii__found").select(*names, F.lit(0).alias("n_replaced"))
    return clean.union(held.select(*names, changed.alias("n_replaced")))
