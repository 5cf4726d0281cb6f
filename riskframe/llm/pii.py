"""Surrogates for personal data, with DataFrame functions only.

One pattern finds all entities of a text; each mention has a type and a
canonical form (the same for all its spellings).  Every canonical form gets a
surrogate of its type, drawn by a keyed hash: digits for digits, letters for
letters of the same case, addresses with valid parts, card numbers with a
valid check digit, names of the same gender and script.  The words of a name are
entities of their own, given or family name, so that short and long forms of a
name agree.  Surrogates that
coincide with each other or with a real entity are drawn again until none
does, so different entities stay different and mentions of one entity stay
equal, in the whole table.  The text is put together from the pieces between
the mentions and the surrogates in the form of each mention.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import cut

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
# Titles and first names by gender and script, syllables of family names.
TITLES = {
    ("latin", "f"): ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme"],
    ("latin", "m"): ["Mr", "Herr", "Señor", "Sr", "Monsieur"],
    ("cyrillic", "f"): ["Госпожа", "г-жа"],
    ("cyrillic", "m"): ["Господин", "г-н"],
}
#: titles of either gender, and small words within names
NEUTRAL = ["Dr", "Prof", "Professor", "Доктор", "Профессор"]
PARTICLES = ["von", "van", "vom", "zu", "zur", "der", "den", "de", "del", "della", "di", "da", "dos", "du", "la", "le", "el", "al", "bin", "ibn", "ter", "ten"]
FIRST = {
    ("latin", "f"): ["Alma", "Clara", "Dora", "Elena", "Flora", "Greta", "Helga", "Irene", "Julia", "Karla", "Lena", "Marta", "Nora", "Paula", "Rita", "Vera"],
    ("latin", "m"): ["Albert", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Klaus", "Lucas", "Mario", "Otto", "Peter", "Viktor"],
    ("cyrillic", "f"): ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Глеб", "Иван", "Олег", "Павел", "Юрий"],
}
SYLLABLES = {
    "latin": ["ba", "den", "fel", "gor", "han", "jor", "kel", "lin", "mar", "nes", "pol", "ras", "sen", "tam", "ver", "wil"],
    "cyrillic": ["ба", "вел", "гор", "дан", "зор", "кал", "лин", "мар", "нес", "пол", "рас", "сен", "там", "вер", "фил", "хан"],
}
_TITLE = "|".join(t for titles in [*TITLES.values(), NEUTRAL] for t in titles)
_TITLES = rf"(?:(?:{_TITLE})\.? )++"
_INITIALS = r"(?:\p{Lu}\. ?|\p{Lu} )*+"
_WORD = (rf"(?!(?:{_TITLE})[. ])\p{{Lu}}(?:[\p{{L}}\p{{M}}]|['’]\p{{L}})[\p{{L}}\p{{M}}]*+"
         r"(?:['’](?!s(?!\p{L}))\p{L}[\p{L}\p{M}]*+|-\p{Lu}[\p{L}\p{M}]*+)*+")
_PART = rf"(?:(?:{'|'.join(PARTICLES)}) )*+{_INITIALS}{_WORD}"
# the name of a secret and the sign before its value, bare or as a quoted JSON key
_SECRET = r"(?i:\b(?:password|passwd|secret|token|api[_-]?key)(?:\\?[\"'])?[ \t]*[=:][ \t]*)"
# a value: all between its quotes, or from an optional opening quote to the next space, quote, comma or semicolon
_VALUE = r"(?:\\\"[^\"\r\n]++\"|\"(?:[^\"\\\r\n]|\\.)++\"|'(?:[^'\\\r\n]|\\.)++'|(?:\\?[\"'])?[^\s\"',;]+)"
# phone numbers of ten digits
_AMERICAN = (r"(?:(?<![\w+])(?:\+[0-9]{1,3}[ .\-]?)?\([0-9]{3}\)[ .\-]?[0-9]{3}[ .\-][0-9]{4}(?![0-9])"
             r"|(?<![\w+\-.])(?:\+[0-9]{1,3}[ .\-])?[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4}(?![0-9\-]))")
_COUNTRY = "(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
_HEXES = "[0-9A-Fa-f]{1,4}"
#: type and pattern, in the order in which they are tried
PATTERNS = [
    # tried at the start of a run of its letters only (or where the last match ended): within a run it can't do better
    ("email", r"(?:(?<![A-Za-z0-9._%+\-])|\G)[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+"),
    ("secret", _SECRET + _VALUE),
    ("key", r"\bAKIA[0-9A-Z]{16}\b"),
    ("hex", r"(?<![0-9A-Za-z])[0-9a-fA-F]{40}(?![0-9A-Za-z])"),
    ("iban", r"(?<![\w])[A-Z]{2}[0-9]{2} ?[0-9A-Z]{4}(?: ?(?=[A-Z]{0,3}[0-9])[0-9A-Z]{4}){1,6}(?: ?(?=[A-Z]{0,2}[0-9])[0-9A-Z]{1,3})?(?![\w])"),
    ("phone", rf"{_AMERICAN}|(?<![\w+])(?:\+[1-9]|00[1-9][0-9]{{0,2}}[ .\-/])(?:[ .\-/()]{{0,2}}[0-9]){{7,14}}(?![0-9])"),
    ("ssn", r"(?<![\w\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w\-])"),
    ("card", r"(?<![\w\-])(?:(?:[0-9]{4}[ \-]?){3}[0-9]{1,4}|3[0-9]{3}[ \-][0-9]{6}[ \-][0-9]{4,5})(?![\w\-])"),
    ("ipv6", rf"(?<![\w:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:{_HEXES}:){{7}}{_HEXES}"
             rf"|(?=[0-9A-Fa-f]{{3,4}}::|(?:[0-9A-Fa-f]*:){{3}})(?:{_HEXES}(?::{_HEXES}){{0,5}})?::(?:{_HEXES}(?::{_HEXES}){{0,5}})?)(?![\w:])"),
    ("ip", rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\w])(?!\.[0-9])"),
    ("name", rf"(?<![\w]){_TITLES}{_PART}(?: {_PART})*+"),
]
ANY = "|".join(f"(?:{p})" for _, p in PATTERNS)
#: what a text must hold for the pattern to find anything, one condition for each type: an address's sign or a digit
#: (all numbers, IPv6 too), a secret's name, a key's start, a hex number of letters only, a title
NEEDED = ["[0-9@]", r"(?i:password|passwd|secret|token|api[_-]?key)", "AKIA", "[A-Fa-f]{40}", rf"(?:{_TITLE})[. ]"]
REDRAWS = 40


def _may_hold(text: Column) -> Column:
    """False only for texts in which the pattern finds nothing; cheap, as most texts need no more."""
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in NEEDED])


def _quoted(mention: Column) -> tuple[Column, Column, Column]:
    """A mention as name of a secret with opening quote, value, closing quote; other mentions are a value only."""
    head = F.regexp_extract(mention, rf"^({_SECRET}(?:\\?[\"'])?)", 1)
    rest = mention.substr(F.length(head) + 1, F.length(mention))
    tail = F.when(head == "", F.lit("")).otherwise(F.regexp_extract(rest, r"(\\?[\"'])$", 1))
    return head, rest.substr(F.lit(1), F.length(rest) - F.length(tail)), tail


def _kind(mention: Column) -> Column:
    """The type of a mention; a secret whose value is a key or a hex number has the type of its value."""
    head, value, _ = _quoted(mention)
    own = F.lit("secret")
    for kind, pattern in PATTERNS:
        if kind in ("key", "hex"):
            own = F.when(value.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(own)
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS):
        out = F.when(mention.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    # a pattern that looks at the text around a mention still holds for the mention alone
    return F.when(head != "", own).otherwise(F.coalesce(out, F.lit("secret")))


def _canonical(kind: Column, mention: Column) -> Column:
    digits = F.regexp_replace(mention, "[^0-9]", "")
    american = mention.rlike(f"^{_AMERICAN}$")
    phone = F.when(american, F.right(digits, F.lit(10))).otherwise(F.regexp_replace(digits, "^00", ""))
    # +1 and ten digits is the same number as the ten digits
    phone = F.when(phone.rlike("^1[0-9]{10}$"), F.right(phone, F.lit(10))).otherwise(phone)
    return (F.when(kind == "email", F.lower(mention)).when(kind == "phone", phone)
            .when(kind.isin("card", "ssn"), digits).when(kind == "iban", F.regexp_replace(mention, " ", ""))
            .when(kind == "ipv6", _eight(F.lower(mention)))
            .when(kind == "hex", F.lower(_quoted(mention)[1])).when(kind.isin("secret", "key"), _quoted(mention)[1])
            .when(kind == "name", F.lit(None).cast("string")).otherwise(mention))


def _remainder(text: Column) -> Column:
    """A text of digits and capitals as a number (A is 10) modulo 97."""
    def step(r: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), r * 10 + c.cast("int")).otherwise(r * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.split(text, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(step(r, c)))


def _holds(kind: Column, mention: Column) -> Column:
    """Whether a number has the check digits of its type: cards and IBAN; other types have none."""
    digits, code = F.regexp_replace(mention, "[^0-9]", ""), F.regexp_replace(mention, " ", "")
    turned = F.concat(code.substr(F.lit(5), F.length(code)), F.substring(code, 1, 4))
    return F.when(kind == "card", F.call_function("luhn_check", digits)).when(kind == "iban", _remainder(turned) == 1).otherwise(True)


def _eight(address: Column) -> Column:
    """All eight numbers of an IPv6 address, without leading zeros."""
    def numbers(text: Column) -> Column:
        return F.filter(F.split(text, ":"), lambda x: x != "")
    left = numbers(F.substring_index(address, "::", 1))
    right = F.when(address.contains("::"), numbers(F.substring_index(address, "::", -1))).otherwise(F.array().cast("array<string>"))
    every = F.concat(left, F.array_repeat(F.lit("0"), F.lit(8) - F.size(left) - F.size(right)), right)
    return F.array_join(F.transform(every, lambda x: F.regexp_replace(x, "^0+(?=.)", "")), ":")


def _name_parts(names: DataFrame) -> DataFrame:
    """(mention, place, piece, canonical) of names: words with their canonical form; blanks, initials and particles have none.

    The last word and what follows a particle is the family name.  A name of
    one word is a family name unless its word is only known as a given name.
    """
    mention = F.col("mention")
    body = F.regexp_replace(mention, f"^{_TITLES}", "")
    gender = F.lit(None).cast("string")
    for (_, of), titles in TITLES.items():
        gender = F.when(mention.rlike(rf"(?:^| )(?:{'|'.join(titles)})\.? "), F.lit(of)).otherwise(gender)
    given = F.regexp_extract(body, r"^((?:\p{Lu}[^ ]* )*)", 1)

    def pieces(text: Column, role: Column) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(r"(?:\p{Lu}\.)+|[^ \-]+|[ \-]"), F.lit(0)), lambda x: F.struct(x.alias("piece"), role.alias("role")))
    last = F.when(body.contains(" "), F.lit("family")).otherwise(F.lit("only"))
    all_pieces = F.concat(pieces(given, F.lit("given")), pieces(body.substr(F.length(given) + 1, F.length(body)), last))
    parts = names.select("mention", gender.alias("gender"), F.posexplode(all_pieces).alias("place", "x")).select("mention", "gender", "place", "x.piece", "x.role")
    is_word = F.col("piece").rlike(r"^\p{Lu}[^.]")
    parts = cut(parts.withColumn("word", F.when(is_word, F.lower("piece")))
                .withColumn("script", F.when(F.col("piece").rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")))
    known = (parts.where("word is not null").groupBy("script", "word")
             .agg(F.max(F.col("role") == "family").alias("family"), F.max(F.col("role") == "given").alias("first"), F.min("gender").alias("usual")))
    is_given = (F.col("role") == "given") | ((F.col("role") == "only") & F.col("first") & ~F.col("family"))
    canonical = F.when(is_given, F.concat_ws("|", F.concat_ws(" ", "script", F.coalesce("gender", "usual", F.lit("m"))), F.lit("given"), "word")).when(
        F.col("word").isNotNull(), F.concat_ws("|", "script", F.lit("family"), "word"))
    return cut(parts.join(known, ["script", "word"], "left")
               .select("mention", "place", "piece", F.when(F.col("word").isNotNull(), canonical).alias("canonical")))


def _initials(key: str, piece: Column) -> Column:
    """Initials by a keyed rotation of the letters, so different ones stay different."""
    of, to = "", ""
    for letters in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝŁŚŠŻŽ", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ"):
        dealt = sorted(letters, key=lambda c: hashlib.sha256(f"{key}\x1finitial\x1f{c}".encode()).digest())
        of, to = of + "".join(dealt), to + "".join(dealt[1:] + dealt[:1])
    return F.translate(piece, of, to)


def _name_forms(parts: DataFrame, drawn: DataFrame, key: str) -> DataFrame:
    """(mention, kind, form) of names."""
    made = drawn.where("kind = 'name'").select("canonical", F.initcap(F.substring_index("surrogate", "|", -1)).alias("made"))
    piece = F.col("piece")
    upper = (F.upper(piece) == piece) & (F.length(piece) > 2)
    form = F.coalesce(F.when(upper, F.upper("made")).otherwise(F.col("made")), F.when(piece.rlike(r"^\p{Lu}"), _initials(key, piece)), piece)
    whole = F.sort_array(F.collect_list(F.struct("place", form.alias("form"))))
    return (parts.join(made, "canonical", "left").groupBy("mention").agg(whole.alias("all"))
            .select("mention", F.lit("name").alias("kind"),
                    F.concat(F.regexp_extract("mention", f"^({_TITLES})", 1), F.array_join(F.col("all.form"), "")).alias("form")))


def _draw(key: str, n: Column | int) -> Column:
    """A number below 2^32 from the key, type, canonical form, attempt and place ``n``."""
    place = n if isinstance(n, Column) else F.lit(n)
    source = F.concat_ws("\x1f", F.lit(key), F.col("kind"), F.col("canonical"), F.col("attempt").cast("string"), place.cast("string"))
    return F.conv(F.substring(F.sha2(source, 256), 1, 8), 16, 10).cast("long")


def _same_form(key: str, form: Column, digits: str = "0123456789", lower: str = "abcdefghijklmnopqrstuvwxyz") -> Column:
    """Every letter and digit replaced by another of its kind, the rest kept."""
    n = F.length(form)

    def one(i: Column) -> Column:
        c = form.substr(i, F.lit(1))
        at = _draw(key, i)

        def of(letters: str) -> Column:
            return F.lit(letters).substr((at % len(letters) + 1).cast("int"), F.lit(1))
        return (F.when(c.rlike("[0-9]"), of(digits)).when(c.rlike(r"\p{Lu}"), of(lower.upper()))
                .when(c.rlike(r"\p{L}"), of(lower)).otherwise(c))
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), n), one), "")).otherwise(form)


def _surrogate(key: str) -> Column:
    form = F.col("canonical")
    host = F.substring_index(form, "@", -1)
    email = F.concat(_same_form(key, F.substring_index(form, "@", 1)), F.lit("@"), _same_form(key, F.substring_index(host, ".", 1)),
                     F.lit(".example.org"))
    ip = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (_draw(key, i) % 254 + 1).cast("string")), ".")
    body = F.concat(F.substring(form, 1, 1), _same_form(key, form.substr(F.lit(2), F.length(form) - 2)))
    size = F.length(form)

    def luhn(i: Column) -> Column:
        d = body.substr(size - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)
    total = F.aggregate(F.transform(F.sequence(F.lit(1), size - 1), luhn), F.lit(0), lambda s, x: s + x)
    card = F.concat(body, ((F.lit(10) - total % 10) % 10).cast("string"))
    # given names run out soon; later draws have syllables added
    group, attempt = F.substring_index(form, "|", 1), F.col("attempt")
    names = form
    for (script, gender), first in FIRST.items():
        given = F.element_at(F.array(*[F.lit(x) for x in first]), (_draw(key, 1) % len(first) + 1).cast("int"))
        parts = F.array(*[F.lit(x) for x in SYLLABLES[script]])

        def syllables(*places: int) -> Column:
            return F.concat(*[F.element_at(parts, (_draw(key, n) % len(SYLLABLES[script]) + 1).cast("int")) for n in places])
        given = F.lower(F.when(attempt < 3, given).when(attempt < 8, F.concat(given, syllables(2, 3, 4))).otherwise(F.concat(given, syllables(2, 3, 4, 5, 6))))
        family = F.when(attempt < 8, syllables(2, 3, 4, 5)).otherwise(syllables(2, 3, 4, 5, 6, 7))
        names = (F.when(group == f"{script} {gender}", F.concat_ws("|", group, F.lit("given"), given))
                 .when(group == script, F.concat_ws("|", group, F.lit("family"), family)).otherwise(names))
    # IBAN: country kept, check digits by the remainder of the rest, country and 00 modulo 97
    rest = _same_form(key, form.substr(F.lit(5), size))
    left = _remainder(F.concat(rest, F.substring(form, 1, 2), F.lit("00")))
    iban = F.concat(F.substring(form, 1, 2), F.lpad((F.lit(98) - left).cast("string"), 2, "0"), rest)
    country = F.when(size != 10, F.regexp_extract(form, f"^({_COUNTRY})", 1)).otherwise(F.lit(""))
    phone = F.concat(country, _same_form(key, form.substr(F.length(country) + 1, size)))
    kind = F.col("kind")
    return (F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "name", names)
            .when(kind == "iban", iban).when(kind == "phone", phone)
            .when(kind.isin("hex", "ipv6"), _same_form(key, form, lower="abcdef"))
            .when(kind == "key", F.concat(F.lit("AKIA"), _same_form(key, F.substring(form, 5, 16)))).otherwise(_same_form(key, form)))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canonical, surrogate), one to one within a kind and apart from all real entities; written.

    Entities whose surrogate coincides with that of a smaller entity or with a
    real one are drawn again.
    """
    real = cut(entities.select("kind", "canonical").distinct())
    done = None
    todo = real.withColumn("attempt", F.lit(0))
    for attempt in range(REDRAWS):
        # a form of so few values that the draws run out of them gets a longer surrogate
        made = _surrogate(key) if attempt < REDRAWS // 2 else F.concat(_surrogate(key), (_draw(key, 99) % 10_000_000).cast("string"))
        drawn = cut(todo.withColumn("surrogate", made))
        first = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("canonical"))
        taken = real.select("kind", F.col("canonical").alias("surrogate"))
        if done is not None:
            taken = taken.union(done.select("kind", "surrogate"))
        checked = (drawn.withColumn("nth", first)
                   .join(taken.distinct().withColumn("taken", F.lit(True)), ["kind", "surrogate"], "left"))
        checked = cut(checked.select("kind", "canonical", "attempt", "surrogate", ((F.col("nth") == 1) & F.col("taken").isNull()).alias("good")))
        good = checked.where("good").select("kind", "canonical", "surrogate")
        done = good if done is None else cut(done.union(good))
        todo = checked.where("not good").select("kind", "canonical", (F.col("attempt") + 1).alias("attempt"))
        if todo.isEmpty():
            return done
    raise ValueError("surrogates run out: use another key")


def _in_form(kind: Column, mention: Column, surrogate: Column) -> Column:
    """The surrogate in the form of a mention."""
    n = F.length(mention)
    head, value, tail = _quoted(mention)

    def digits_of(text: Column) -> Column:
        return F.regexp_replace(text, "[^0-9]", "")
    skipped = F.length(digits_of(mention)) - F.length(surrogate)

    def one(i: Column) -> Column:
        c = mention.substr(i, F.lit(1))
        at = F.length(digits_of(mention.substr(F.lit(1), i))) - skipped
        return F.when(c.rlike("[0-9]") & (at > 0), surrogate.substr(at, F.lit(1))).otherwise(c)
    numbers = F.array_join(F.transform(F.sequence(F.lit(1), n), one), "")

    def sign(i: Column) -> Column:
        c = mention.substr(i, F.lit(1))
        return F.when(c == " ", c).otherwise(surrogate.substr(F.length(F.regexp_replace(mention.substr(F.lit(1), i), " ", "")), F.lit(1)))
    spaced = F.array_join(F.transform(F.sequence(F.lit(1), n), sign), "")
    return (F.when(kind.isin("phone", "card", "ssn"), F.when(skipped >= 0, numbers).otherwise(surrogate))
            .when(kind == "hex", F.concat(head, F.when(value.rlike("[a-f]"), surrogate).otherwise(F.upper(surrogate)), tail))
            .when(kind.isin("secret", "key"), F.concat(head, surrogate, tail))
            .when(kind == "iban", F.when(F.length(F.regexp_replace(mention, " ", "")) == F.length(surrogate), spaced).otherwise(surrogate))
            .otherwise(surrogate))


def with_surrogates(docs: DataFrame, key: str = "surrogate key") -> DataFrame:
    """(doc, text, kinds, mentions): every row as a struct, its text with surrogates, the kinds and the mentions found.

    Numbers in the form of a card or an IBAN whose check digits are wrong are
    neither and stay.  ``docs`` needs a text column.  Null and empty texts stay as they are.  An
    empty table gives an empty result; equal texts get equal surrogates.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    text = F.col("doc.text")
    has = F.coalesce(_may_hold(text) & text.rlike(ANY), F.lit(False))
    hits = (docs.where(_may_hold(F.col("text"))).select(F.sha2("text", 256).alias("tkey"), F.regexp_extract_all("text", F.lit(ANY), F.lit(0)).alias("mentions"))
            .where(F.size("mentions") > 0).distinct())
    each = hits.select("tkey", F.posexplode("mentions").alias("place", "mention"))
    each = cut(each)
    kinds = cut(each.select("mention").distinct().withColumn("kind", _kind(F.col("mention")))
                .withColumn("kind", F.when(_holds(F.col("kind"), F.col("mention")), F.col("kind")))
                .withColumn("canonical", _canonical(F.col("kind"), F.col("mention"))))
    parts = _name_parts(kinds.where("kind = 'name'"))
    entities = kinds.select("kind", "canonical").union(parts.select(F.lit("name").alias("kind"), "canonical")).where("canonical is not null")
    drawn = surrogates(entities, key)
    others = kinds.join(drawn, ["kind", "canonical"])
    forms = cut(others.select("mention", "kind", _in_form(F.col("kind"), F.col("mention"), F.col("surrogate")).alias("form"))
                .union(_name_forms(parts, drawn, key))
                .union(kinds.where("kind is null").select("mention", "kind", F.col("mention").alias("form"))))
    made = (each.join(forms, "mention").groupBy("tkey")
            .agg(F.sort_array(F.collect_list(F.struct("place", "form", "kind", "mention"))).alias("all")))
    empty = F.array().cast("array<string>")
    without = rows.where(~has).select("doc", text.alias("text"), empty.alias("kinds"), empty.alias("mentions"))
    whole = F.array_join(F.zip_with(F.split(text, ANY, -1), F.col("all.form"), lambda p, f: F.concat(p, F.coalesce(f, F.lit("")))), "")
    real = F.filter("all", lambda x: x["kind"].isNotNull())
    with_hits = (rows.where(has).withColumn("tkey", F.sha2(text, 256)).join(made, "tkey")
                 .select("doc", whole.alias("text"), F.transform(real, lambda x: x["kind"]).alias("kinds"),
                         F.transform(real, lambda x: x["mention"]).alias("mentions")))
    return with_hits.union(without)


def surrogate_report(docs: DataFrame, key: str = "surrogate key") -> DataFrame:
    """(doc_id, text, kinds, entities) of every document: the text with surrogates, kinds in order of place, their number."""
    out = with_surrogates(docs.select("doc_id", "text"), key)
    return out.select(F.col("doc.doc_id").alias("doc_id"), "text", "kinds", F.size("kinds").alias("entities"))
