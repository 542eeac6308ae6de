r"""PII surrogates: keyed, type-consistent, distinct and coreferent replacements.

Everything is DataFrame and SQL functions.  One pattern finds e-mail addresses,
phone numbers, IPv4 and IPv6 addresses, payment cards, IBANs, social security numbers,
secrets and names behind a title or a phrase such as "my name is".  The mutable characters of an
entity (digits, letters by case and script, hexadecimal digits, octets) are replaced by a
keyed Feistel network over their mixed radices.  For one key, type and format it is a
permutation: two entities never get one surrogate, and one entity gets the same everywhere.
Format stays: case, separators, country code, card issuer, Luhn and IBAN checks,
trunk 0, top-level domain, lengths.

Names are replaced word by word.  A word's gender is that of its title, else that of the
list it is in; words that stand last in a name of two words have none.  A listed
first name becomes another of its list, other words keep their pattern of vowels and
consonants (or their script), those of a gender end like one.  A word that a
document introduces as a name is replaced wherever it recurs there, in capitals too.

The distinct entities of all texts get their surrogates once, in a table.  A collision check
goes over it: an entity whose surrogate is also an original somewhere, or is
met by another entity, is given another permutation until none is
left.  After MOST_TRIES permutations in its own format the space of a name, e-mail
address or secret grows, a listed name leaving its list and then two letters more in
each try; LAST_TRIES without an end raise.  Entities without a mutable character
stay as they are.  Each text with entities then gets a map of its mentions, by a
128-bit hash of the text; a small table of maps is broadcast, a larger one is joined.

Null texts stay null; texts without entities stay as they are.  Repeated rows
are replaced alike; null ids too.  An empty table gives no rows.  Other columns
stay, named as they were, but for one named n_entities_, which the count replaces.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempoweir.llm.common import cut, fresh, table

ROUNDS = 6
MOST_TRIES = 8  # within the own format; more letters from then on
LAST_TRIES = 64
BROADCAST_BYTES = 4 << 20
DEFAULT_KEY = "tempoweir-demo-key"

# Alphabets of mutable characters, first names by gender, titles.
DIGITS, LATIN, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
ACCENTED = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
GREEK = "αβγδεζηθικλμνξοπρστυφχψω"
CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюя"
#: First code point and size of alphabets that are ranges: Hangul, Han, kana, Arabic, Hebrew, Devanagari, Thai.
RANGES = ((0xAC00, 11172), (0x4E00, 20902), (0x3041, 86), (0x30A1, 90), (0x0621, 26), (0x0641, 10), (0x05D0, 27), (0x0915, 37), (0x0E01, 46))
VOWELS, CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxyz"
FEMALE = "anna maria laura julia sofia emma clara elena lucia marta alice sarah emily grace helen karen susan linda nora ida"
MALE = "john james peter paul david daniel thomas martin robert george henry frank oliver lucas max felix carlos diego pablo jean"
TITLES_F, TITLES_M = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Госпожа|Κυρία", "Mr|Herr|Monsieur|Señor|Sr|Don|Господин|Κύριος"
CUES = "my name is|name ?:|mein Name ist|ich heiße|je m'appelle|me llamo|mi nombre es"

LABELS = "token|secret|password|api_key"

_EDGE = r"(?<![\p{L}\p{N}])"
_TITLE = rf"(?:{TITLES_F}|{TITLES_M}|Dr|Prof)\.? "
_WORD = r"(?:\p{Lu}\p{Ll}++|\p{Lo}[\p{Lo}\p{M}ー]{1,15}+)"
_NAME = rf"{_EDGE}(?:{_TITLE}|(?=\p{{Lu}}|\p{{Lo}})(?<={_EDGE}(?i:{CUES}) ?)){_WORD}(?: {_WORD})?(?![\p{{L}}\p{{N}}])"
_HEXTET = "[0-9a-fA-F]{1,4}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_CODE = r"\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{1,3})"
_CLEAR, _CLOSED = r"(?<![\p{L}\p{N}.,:/+-])", r"(?!\p{N}|\p{L}|[.:]\d)"
PHONES = (
    # country code 1 and ten digits; any country code and 7 to 15 digits in any grouping
    rf"{_EDGE}\+1[ .-]?\(?\d{{3}}\)?[ .-]?\d{{3}}[ .-]?\d{{4}}(?!\d)",
    rf"{_EDGE}\+\d(?:[ ./-]?\(?\d\)?){{6,14}}(?!\d)",
    # area code in brackets; three, three and four digits; trunk 0 and 8 digits or more in groups or pairs
    rf"(?<![\p{{L}}\p{{N}}])\(\d{{2,5}}\) ?(?:\d{{3,4}}[ .-]?\d{{3,4}}|\d{{5,8}}|\d{{2}}(?:[ .-]\d{{2}}){{2,3}}){_CLOSED}",
    rf"{_CLEAR}(?:1[ .-])?[2-9]\d{{2}}([ .-])\d{{3}}\1\d{{4}}{_CLOSED}",
    rf"{_CLEAR}(?=(?:[ ./-]?\d){{8}})0\d(?:(?:[ .-]\d{{2}}){{4}}|\d{{0,3}}[ /-]\d{{3,8}}(?:[ -]\d{{2,8}}){{0,3}}+){_CLOSED}",
    # any grouping behind a label
    r"(?=\(?\d)(?<=[\p{L}.: ])(?<=(?<![\p{L}\p{N}])(?i:tel|phone|telephone|mobile|cell|fax|call)[.:]{0,2} ?)\(?\d(?:[ ./-]?\(?\d\)?){6,14}(?!\d)",
)
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){0,6}\.\p{L}{2,24}",
    "phone": "|".join(PHONES),
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\d]|\.\d)",
    "ip6": rf"(?<![\p{{L}}\p{{N}}:.])(?:(?:{_HEXTET}:){{7}}{_HEXTET}|(?=[a-fA-F:]{{0,31}}\d){_HEXTET}(?::{_HEXTET}){{0,5}}::{_HEXTET}(?::{_HEXTET}){{0,5}})(?![\p{{L}}\p{{N}}:]|\.\d)",
    "iban": rf"{_EDGE}(?=(?: ?[A-Z0-9]){{15}})[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?(?![\p{{L}}\p{{N}}])",
    "card": rf"{_EDGE}(?:\d{{4}}[ -]\d{{4}}[ -]\d{{4}}[ -]\d{{1,7}}|\d{{4}}[ -]\d{{6}}[ -]\d{{4,5}}|\d{{13,19}})(?![\p{{L}}\p{{N}}])",
    "ssn": rf"{_EDGE}\d{{3}}-\d{{2}}-\d{{4}}(?![\p{{L}}\p{{N}}-])",
    "secret": rf"{_EDGE}[0-9a-fA-F]{{32,}}+(?![\p{{L}}\p{{N}}])|(?<=[=: \"])(?<=[=:] ?\"?)(?<=(?:{LABELS}) ?[=:] ?\"?)[A-Za-z0-9_/+=.-]{{11,}}[A-Za-z0-9_/+=-]",
    "name": _NAME,
}
#: Places inside a word are passed over; only IPv4 addresses may begin there.
_START = r"(?<![\p{L}\p{N}])(?=[\p{L}\p{N}+(._%/=-])"
PATTERN = f"{_START}(?:{'|'.join(f'(?:{p})' for p in KINDS.values())})|(?:{KINDS['ip']})"


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _alphabet(kind: Column, c: Column) -> Column:
    """(letters, first code point, size) of a lower-cased character's alphabet, null if it stays."""
    of = lambda letters: F.struct(F.lit(letters).alias("a"), F.lit(0).alias("lo"), F.lit(len(letters)).alias("n"))
    among = lambda *sets: reduce(lambda w, x: w.when(F.instr(F.lit(x), c) > 0, of(x)), sets[1:], F.when(F.instr(F.lit(sets[0]), c) > 0, of(sets[0])))
    itself = F.struct(c.alias("a"), F.lit(0).alias("lo"), F.lit(1).alias("n"))
    ranged = reduce(
        lambda w, r: w.when(F.ascii(c).between(r[0], r[0] + r[1] - 1), F.struct(F.lit("").alias("a"), F.lit(r[0]).alias("lo"), F.lit(r[1]).alias("n"))), RANGES, F.when(F.lit(False), None)
    )
    return (
        F.when(kind == "hex", F.coalesce(among(HEX), itself))
        .when(kind == "name", F.coalesce(among(VOWELS, CONSONANTS, ACCENTED, GREEK, CYRILLIC), ranged))
        .when(kind == "secret", F.coalesce(among(DIGITS, LATIN), itself))
        .when(kind.isin("email", "domain", "iban"), among(DIGITS, LATIN, ACCENTED, GREEK, CYRILLIC))
        .otherwise(among(DIGITS))
    )


def _let(value: Column, f) -> Column:
    """f(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def permuted(values: Column, radices: Column, tweak: Column) -> Column:
    """Keyed permutation of integers below their radices (generalised Feistel, even and odd places in turn)."""
    joined = lambda xs: F.array_join(F.transform(xs, lambda y: y.cast("string")), ",")

    def turn(acc: Column, r: Column) -> Column:
        rest = joined(F.filter(acc["v"], lambda _, j: j % 2 != r % 2))
        seed = F.sha2(F.concat_ws("|", acc["t"], r.cast("string"), rest), 256)

        def moved(seed: Column) -> Column:
            step = lambda i: F.conv(seed.substr(1 + (i * 4) % 56, F.lit(6)), 16, 10).cast("long")
            return F.transform(acc["v"], lambda x, i: F.when(i % 2 == r % 2, F.pmod(x + step(i), F.element_at(acc["r"], i + 1))).otherwise(x))

        return F.struct(_let(seed, moved).alias("v"), acc["r"].alias("r"), acc["t"].alias("t"))

    start = F.struct(values.alias("v"), radices.alias("r"), F.concat_ws("|", tweak, joined(radices)).alias("t"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda acc: acc["v"])


def _replaced(s: Column, kind: Column, tweak: Column) -> Column:
    """Text of the same format: mutable characters permuted, case and all others kept."""
    marked = F.transform(_chars(s), lambda c: F.struct(c.alias("c"), F.lower(c).alias("l"), _alphabet(kind, F.lower(c)).alias("a")))

    def rebuilt(marked: Column) -> Column:
        mutable = F.filter(marked, lambda m: m["a"].isNotNull())
        new = permuted(
            F.transform(mutable, lambda m: F.when(m["a"]["lo"] > 0, F.ascii(m["l"]) - m["a"]["lo"]).otherwise(F.instr(m["a"]["a"], m["l"]) - 1).cast("long")),
            F.transform(mutable, lambda m: m["a"]["n"].cast("long")),
            F.concat_ws("|", tweak, kind),
        )

        def put(m: Column, v: Column) -> Column:
            drawn = F.decode(F.unhex(F.lpad(F.hex(m["a"]["lo"] + v), 4, "0")), "UTF-16BE")
            char = F.when(m["a"]["lo"] > 0, drawn).otherwise(m["a"]["a"].substr((v + 1).cast("int"), F.lit(1)))
            return F.when(m["a"].isNull(), m["c"]).otherwise(F.when(m["c"] != m["l"], F.upper(char)).otherwise(char))

        def step(acc: Column, m: Column) -> Column:
            n = acc["n"] + F.when(m["a"].isNull(), 0).otherwise(1)
            return F.struct(F.concat(acc["s"], put(m, F.element_at(acc["v"], acc["n"] + 1))).alias("s"), n.cast("int").alias("n"), acc["v"].alias("v"))

        def joined(new: Column) -> Column:
            # secrets may be long: all their characters have a value, so none needs a count of those before it
            even = F.array_join(F.transform(marked, lambda m, i: put(m, F.element_at(new, i + 1))), "")
            uneven = F.aggregate(marked, F.struct(F.lit("").alias("s"), F.lit(0).alias("n"), new.alias("v")), step, lambda acc: acc["s"])
            return F.when(kind.isin("secret", "hex"), even).otherwise(uneven)

        return _let(new, joined)

    return _let(marked, rebuilt)


def _luhn(digits: Column) -> Column:
    """Check digit that completes ``digits``."""
    double = lambda c: F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)
    each = F.transform(F.reverse(_chars(digits)), lambda c, i: F.when(i % 2 == 0, double(c)).otherwise(c.cast("int")))
    total = F.aggregate(each, F.lit(0), lambda a, x: a + x)
    return F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10))


def _spread(s: Column, digits: Column) -> Column:
    """``s`` with its digits replaced by those of ``digits``, in order."""

    def step(acc: Column, c: Column) -> Column:
        is_digit = c.rlike("[0-9]")
        put = F.when(is_digit, acc["d"].substr(acc["n"] + 1, F.lit(1))).otherwise(c)
        return F.struct(F.concat(acc["s"], put).alias("s"), (acc["n"] + is_digit.cast("int")).alias("n"), acc["d"].alias("d"))

    return F.aggregate(_chars(s), F.struct(F.lit("").alias("s"), F.lit(0).alias("n"), digits.alias("d")), step, lambda acc: acc["s"])


def kind_of(entity: Column) -> Column:
    out = F.lit("name")
    out = F.when(entity.rlike("^[(0-9][0-9 ./()-]+$"), "phone").otherwise(out)  # found by its label
    for kind in reversed([k for k in ("email", "ssn", "card", "phone", "ip", "ip6", "iban")]):
        out = F.when(entity.rlike(f"^(?:{KINDS[kind]})$"), kind).otherwise(out)
    shaped = "|".join(KINDS[k] for k in ("ssn", "card", "phone", "ip", "iban"))
    secret = entity.rlike("^(?:[0-9a-fA-F]{32,}|(?![0-9.-]{0,24}$)[A-Za-z0-9_/+=.-]{12,})$") & ~entity.contains("@")
    out = F.when(secret & ~entity.rlike(f"^(?:{shaped})$"), "secret").otherwise(out)
    return F.when(entity.rlike("^[0-9]{13,19}$"), "card").otherwise(out)


def canonical(entity: Column, kind: Column) -> Column:
    """What mentions of one entity share: case, title and separators do not count."""
    return (
        F.when(kind == "phone", F.regexp_replace(entity, "[^0-9+]", ""))
        .when(kind.isin("card", "ssn"), F.regexp_replace(entity, "[^0-9]", ""))
        .when(kind == "iban", F.lower(F.regexp_replace(entity, " ", "")))
        .when(kind == "ip", entity)
        .otherwise(F.lower(entity))
    )


def _listed(word: Column) -> Column:
    """Gender of a listed first name, null for others."""
    female, male = (F.array(*[F.lit(x) for x in names.split()]) for names in (FEMALE, MALE))
    return F.when(F.array_contains(female, F.lower(word)), "F").when(F.array_contains(male, F.lower(word)), "M")


def _known_name(word: Column, gender: Column, tweak: Column) -> Column:
    """Another first name of the gender's list, null for a word that is not in it; in capitals if the word is."""
    female, male = (F.array(*[F.lit(x) for x in names.split()]) for names in (FEMALE, MALE))
    own = F.when(gender == "F", female).when(gender == "M", male)

    def other(of: Column) -> Column:
        at = F.array_position(of, F.lower(word)) - 1
        moved = F.element_at(permuted(F.array(at), F.array(F.size(of).cast("long")), F.concat_ws("|", tweak, gender)), 1)
        name = F.element_at(of, (moved + 1).cast("int"))
        return F.when(at >= 0, F.when(F.upper(word) == word, F.upper(name)).otherwise(F.initcap(name)))

    return F.when(_listed(word) == gender, _let(own, other))


def _iban_check(digits: Column) -> Column:
    """Two check digits of an IBAN (lower-cased, without spaces), those it has not counting."""
    moved = F.concat(digits.substr(F.lit(5), F.length(digits)), digits.substr(F.lit(1), F.lit(2)), F.lit("00"))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 87)
    rest = F.aggregate(_chars(moved), F.lit(0), lambda a, c: _let(value(c), lambda v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97))
    return F.lpad((98 - rest).cast("string"), 2, "0")


def surrogate(entity: Column, kind: Column, gender: Column, key: str, tries: Column) -> Column:
    """Surrogate of one mention (of one word of a name): its pieces, each kept or permuted in an alphabet under a tweak."""
    tweak = F.concat_ws("|", F.lit(key), kind, tries.cast("string"))
    more = F.repeat(F.lit("na"), F.greatest(F.lit(0), tries - MOST_TRIES).cast("int"))

    def piece(s: Column, alphabet: Column | str | None = None, own: Column = tweak) -> Column:
        a = alphabet if isinstance(alphabet, Column) else F.lit(alphabet).cast("string")
        return F.struct(s.alias("s"), a.alias("a"), own.alias("t"))

    at, dot = F.instr(entity, "@"), F.length(F.regexp_extract(entity, r"\.\p{L}+$", 0))
    domain = entity.substr(at + 1, F.length(entity) - at - dot)
    email = F.array(
        piece(F.concat(entity.substr(F.lit(1), at - 1), more), "email", F.concat_ws("|", tweak, F.lower(domain))), piece(F.lit("@")),
        piece(domain, "domain", F.lit(key)), piece(entity.substr(at + 1 + F.length(domain), dot)),
    )
    code = F.regexp_extract(entity, rf"^(?:{_CODE}|\(?0)", 0)  # country code or trunk 0
    phone = F.array(piece(code), piece(entity.substr(F.length(code) + 1, F.length(entity)), "phone", F.concat_ws("|", tweak, F.regexp_replace(code, r"\(", ""))))
    digits = F.regexp_replace(entity, "[^0-9]", "")
    issuer, last = digits.substr(F.lit(1), F.lit(1)), digits.substr(F.length(digits), F.lit(1)).cast("int")
    card = F.array(piece(issuer), piece(digits.substr(F.lit(2), F.length(digits) - 2), "card", F.concat_ws("|", tweak, issuer)))
    iban = F.array(piece(entity.substr(F.lit(1), F.lit(4))), piece(entity.substr(F.lit(5), F.length(entity)), "iban", F.concat_ws("|", tweak, entity.substr(F.lit(1), F.lit(2)))))
    # after MOST_TRIES, groups of an IPv6 address get all four digits
    groups = F.array_join(F.transform(F.split(entity, ":"), lambda g: F.when(g != "", F.lpad(g, 4, "0")).otherwise(g)), ":")
    wide = F.when(kind == "secret", F.concat(entity, more)).when((kind == "ip6") & (tries >= MOST_TRIES), groups).otherwise(entity)
    whole = F.array(piece(wide, F.when(kind == "ssn", "ssn").when((kind == "ip6") | entity.rlike("^[0-9a-fA-F]+$"), "hex").otherwise("secret")))
    capitals = F.length(entity) > 1
    longer = F.concat(entity, F.when(capitals & (F.upper(entity) == entity), F.upper(more)).otherwise(more))
    word = F.array(piece(longer, "name", F.concat_ws("|", tweak, gender)))
    pieces = F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "card", card).when(kind == "iban", iban).when(kind == "name", word).otherwise(whole)
    joined = F.array_join(F.transform(pieces, lambda p: F.when(p["a"].isNull(), p["s"]).otherwise(_replaced(p["s"], p["a"], p["t"]))), "")

    def gendered(name: Column) -> Column:
        # Latin words of four letters or more end in a, or else in no vowel but o
        end = F.when(gender == "F", F.regexp_replace(name, "(?<=[A-Za-z]{3})[a-z]$", "a")).otherwise(F.regexp_replace(name, "(?<=[A-Za-z]{3})[aeiu]$", "o"))
        end = F.when(name.rlike("[a-z]$"), end).when(gender == "F", F.regexp_replace(name, "(?<=[A-Z]{3})[A-Z]$", "A")).otherwise(F.regexp_replace(name, "(?<=[A-Z]{3})[AEIU]$", "O"))
        return F.when(gender == "N", name).otherwise(end)

    off = last - _luhn(digits.substr(F.lit(1), F.length(digits) - 1))
    luhn = lambda m: _spread(entity, F.concat(m, F.pmod(_luhn(m) + off, F.lit(10)).cast("string")))
    checked = lambda m: F.concat(m.substr(F.lit(1), F.lit(2)), _iban_check(F.lower(F.regexp_replace(m, " ", ""))), m.substr(F.lit(5), F.length(m)))
    octets = F.transform(F.split(entity, r"\."), lambda x: x.cast("long"))
    ip = F.array_join(F.transform(permuted(octets, F.array_repeat(F.lit(256).cast("long"), 4), tweak), lambda x: x.cast("string")), ".")
    named = lambda m: F.coalesce(F.when(tries < MOST_TRIES, _known_name(entity, gender, tweak)), gendered(m))
    return F.when(kind == "ip", ip).otherwise(_let(joined, lambda m: F.when(kind == "card", luhn(m)).when(kind == "iban", checked(m)).when(kind == "name", named(m)).otherwise(m)))


def entities(text: Column) -> Column:
    """Mentions in order; texts without a digit, ``@``, title, cue, secret's label or 32 hexadecimal letters are not searched."""
    cheap = "[0-9@]", ":[a-fA-F]{1,4}:", "[a-fA-F]{32}", rf"(?:{LABELS}) ?[=:]", rf"(?<![\p{{L}}\p{{N}}])(?=[MFSDPHГΚ]){_TITLE}", rf"(?<![\p{{L}}\p{{N}}])(?=[MmNnIiJj])(?i:{CUES})"
    may = reduce(lambda x, y: x | y, [text.rlike(p) for p in cheap])
    return F.when(may, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _fixed(canon: Column, kind: Column) -> Column:
    """Whether no character of an entity can be replaced."""
    ranges = "".join(f"{chr(lo)}-{chr(lo + n - 1)}" for lo, n in RANGES)
    mutable = F.when(kind == "email", F.regexp_replace(canon, r"\.\p{L}+$", "")).otherwise(canon).rlike(f"[{DIGITS}{LATIN}{ACCENTED}{GREEK}{CYRILLIC}{ranges}]")
    return kind.isin("name", "email", "secret") & ~mutable


def _text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text), F.xxhash64(F.lit("second"), text)]


def mentions(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(a, b, e, i, lead, p, kind, gender, bare): the pieces p of each text's distinct mentions e, after a lead that stays.

    a and b are hashes of the text.  A name's words are pieces of their own; ``bare`` mentions are
    the words that a text introduces as names, to be found wherever they recur.
    """
    a, b = _text_key(F.col(text_col))
    found = docs.select(a.alias("a"), b.alias("b"), F.explode(entities(F.col(text_col))).alias("e")).distinct()
    found = cut(found.withColumn("kind", kind_of(F.col("e"))))
    other = found.where("kind <> 'name'").select("a", "b", "e", F.lit(0).alias("i"), F.lit("").alias("lead"), F.col("e").alias("p"), "kind", F.lit("N").alias("gender"), F.lit(False).alias("bare"))
    title = F.regexp_extract("e", f"^{_TITLE}", 0)
    names = found.where("kind = 'name'").withColumn("title", title).withColumn("words", F.split(F.expr("substring(e, length(title) + 1)"), " "))
    words = names.select("a", "b", "e", "title", F.size("words").alias("n"), F.posexplode("words").alias("i", "p"))
    role = F.max("i").over(Window.partitionBy("a", "b", F.lower("p")))
    of_title = F.when(F.col("title").rlike(f"^(?:{TITLES_F})[. ]"), "F").when(F.col("title").rlike(f"^(?:{TITLES_M})[. ]"), "M")
    words = words.withColumn("gender", F.when(role == 1, "N").otherwise(F.coalesce(of_title, _listed(F.col("p")), F.lit("N"))))
    own = words.where("title <> '' OR n > 1").select(
        "a", "b", "e", "i", F.when(F.col("i") == 0, F.col("title")).otherwise(" ").alias("lead"), "p", F.lit("name").alias("kind"), "gender", F.lit(False).alias("bare")
    )
    again = words.groupBy("a", "b", "p").agg(F.min("gender").alias("gender")).withColumn("e", F.explode(F.array_distinct(F.array("p", F.upper("p")))))
    again = again.groupBy("a", "b", "e").agg(F.min("gender").alias("gender"))
    again = again.select("a", "b", "e", F.lit(0).alias("i"), F.lit("").alias("lead"), F.col("e").alias("p"), F.lit("name").alias("kind"), "gender", F.lit(True).alias("bare"))
    return cut(other.unionByName(own).unionByName(again))


def surrogates(pieces: DataFrame, key: str = DEFAULT_KEY) -> DataFrame:
    """(kind, gender, p, s): the surrogate of each distinct piece; no two entities share one and none is an original."""
    entity = ["kind", "gender", "canon"]

    def made(rows: DataFrame) -> DataFrame:
        s = surrogate(F.col("p"), F.col("kind"), F.col("gender"), key, F.col("tries"))
        rows = rows.select(*entity, "p", "tries", F.when(_fixed(F.col("canon"), F.col("kind")), F.col("p")).otherwise(s).alias("s"))
        return cut(rows.withColumn("to", canonical(F.col("s"), F.col("kind"))))

    held = made(pieces.select("kind", "gender", "p").distinct().select("*", canonical(F.col("p"), F.col("kind")).alias("canon"), F.lit(0).alias("tries")))
    originals = held.select("kind", F.col("canon").alias("to")).distinct()
    for _ in range(LAST_TRIES):
        live = held.where(~_fixed(F.col("canon"), F.col("kind"))).select(*entity, "to")
        taken = live.join(originals, ["kind", "to"], "left_semi").select(*entity)
        # grouped with partial sums: all of a group but its least entity try again
        who = F.struct("gender", "canon")
        twice = live.groupBy("kind", "to").agg(F.min(who).alias("least"), F.max(who).alias("most")).where("least <> most").select("kind", "to", "least")
        twice = live.join(twice, ["kind", "to"]).where(who != F.col("least")).select(*entity)
        again = cut(taken.unionByName(twice).distinct())
        if again.isEmpty():
            return held.select("kind", "gender", "p", "s")
        more = made(held.join(again, entity).withColumn("tries", F.col("tries") + 1))
        held = cut(held.join(again, entity, "left_anti").unionByName(more))
    raise ValueError(f"surrogates still collide after {LAST_TRIES} tries")


def replace_pii(docs: DataFrame, key: str = DEFAULT_KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with surrogates in the text, and n_entities_."""
    pieces = mentions(docs, text_col)
    new = pieces.join(surrogates(pieces, key), ["kind", "gender", "p"])
    new = new.groupBy("a", "b", "e").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", F.concat("lead", "s").alias("s")))), lambda x: x["s"]), "").alias("s"), F.max("bare").alias("bare"))
    a, b, of, pattern, found, between = fresh(docs, "a_", "b_", "of_", "pattern_", "found_", "between_")
    cased, plain = (F.array_join(F.collect_list(F.when(F.col("bare") & (F.col("e").rlike(r"^\p{Lu}") == F.lit(is_cased)), F.col("e"))), "|") for is_cased in (True, False))
    maps = new.groupBy("a", "b").agg(F.map_from_entries(F.collect_list(F.struct("e", "s"))).alias(of), cased.alias("cased"), plain.alias("plain"))
    bare = F.concat(F.when(F.col("cased") != "", F.concat(F.lit(f"|{_EDGE}(?:"), "cased", F.lit(r")(?![\p{L}\p{N}])"))).otherwise(""), F.when(F.col("plain") != "", F.concat(F.lit("|"), "plain")).otherwise(""))
    maps = cut(maps.select(F.col("a").alias(a), F.col("b").alias(b), of, F.concat(F.lit(PATTERN), bare).alias(pattern)))
    width = F.sum(F.octet_length(pattern) + F.length(F.array_join(F.map_keys(of), "")) + F.length(F.array_join(F.map_values(of), "")))
    if (maps.agg(width.alias("n")).first()["n"] or 0) <= BROADCAST_BYTES:
        maps = F.broadcast(maps)
    text = F.col(text_col)
    keyed = docs.withColumns(dict(zip((a, b), _text_key(text), strict=True))).join(maps, [a, b], "left")
    keyed = keyed.withColumn(found, F.when(F.col(pattern).isNotNull(), F.regexp_extract_all(text, F.col(pattern), F.lit(0))))
    keyed = keyed.withColumn(between, F.when(F.col(pattern).isNotNull(), F.split(text, F.col(pattern), -1)))
    # a mention without a surrogate cannot be; were it so, it would be blotted out
    put = F.transform(found, lambda e: F.coalesce(F.try_element_at(F.col(of), e), F.repeat(F.lit("*"), F.length(e))))
    whole = F.concat(F.array_join(F.zip_with(F.slice(between, 1, F.size(found)), put, lambda x, y: F.concat(x, y)), ""), F.element_at(between, -1))
    changed = keyed.withColumn(text_col, F.when(F.size(found) > 0, whole).otherwise(text))
    return changed.select(*[c for c in docs.columns if c.lower() != "n_entities_"], F.greatest(F.lit(0), F.coalesce(F.size(found), F.lit(0))).cast("long").alias("n_entities_"))


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("n_entities_", "n_entities")


def hide_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents, with surrogates in their texts and n_chars to match."""
    return replace_pii(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


QUERIES = {"op5_pii_surrogates": op5_pii_surrogates}
#: The keyed permutation has no SQL of another engine; tests check it entity by entity.
ORACLE: dict[str, str] = {}
