"""Personal data replaced by surrogates (operator 8; SQL functions only).

*Detection.* One pattern finds e-mail addresses, IP addresses (not after "version"), phone, card and
identity numbers, IBANs, secrets (long hexadecimal strings, keys with a known
prefix, long strings of mixed letters and digits) and names after a form of
address. Further mentions of these names in the same document are replaced too.
*Units.* An entity is reduced to what coreference depends on: a
phone number to its last ten digits without prefixes of country and trunk, an address to lower case, a person to given
name and surname, each replaced by itself, so that "Mr. Jo Smith" and "Mr. Smith"
stay one person. In a document that has "Mrs. Jo Smith", "Dr. Jo Smith" is she.

*Surrogates* come from the HMAC of kind and unit under the caller's key: digits for digits and
letters for letters in the format found; card numbers and IBANs with valid check
digits where the original has them; names in the script found, with an ending by
gender. Addresses go to a reserved domain.

*Collisions.* Over the distinct units of all documents, a surrogate that another
unit already has, or that is itself a unit found, is drawn again with the next
attempt, until all are distinct. Names and mail domains grow with the attempt, so
that there are always more of them than units. The few units drawn again are joined to the
documents that hold them; all other documents need no join.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import bitmap
from tessera.llm.columns import free_name
from tessera.plans.scratch import stage

#: A public key, for tests and for queries without the setting; never a default of a function.
KEY = "surrogates-1"
ID_BITS, ATTEMPTS = 1 << 25, 40

MALE = "Mr|MR|Mister|Herr|HERR|Señor|SEÑOR|Sr|SR|Monsieur|MONSIEUR|Господин|г-н|Κύριος"
FEMALE = "Mrs|MRS|Ms|MS|Miss|MISS|Frau|FRAU|Señora|SEÑORA|Señorita|Sra|SRA|Madame|MADAME|Mme|MME|Mlle|Госпожа|г-жа|Κυρία"
NEUTRAL = "Dr|DR|Prof|PROF|Professor"
#: A name ends before a possessive.
_ALNUM, _NAME = r"\p{L}\p{N}", r"\p{Lu}(?:[\p{L}\-]|['’](?![sS](?!\p{L})))+"
#: Numbers as written in Europe and America; grouped by one kind of separator where it could be a date or a list.
_GROUPED = r"(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{2,4}[ .\-])\d{3,4}[ .\-]\d{3,4}(?![ \-]?\d)|\+\d{7,15}(?!\d)"
_PHONES = [
    # France.
    r"(?:(?:\+|00)33[ .\-]?(?:\(0\) ?)?|0)[1-9](?:(?: \d{2}){4}|(?:\.\d{2}){4}|(?:-\d{2}){4}|\d{8})(?![ .\-]?\d)",
    # Spain.
    r"(?:(?:\+|00)34[ .\-]?)?(?:[6-9]\d{2}(?:(?: \d{2}){3}|(?:\.\d{2}){3}|(?:-\d{2}){3}|\d{6})|[89]\d(?: \d{3} \d{2} \d{2}|-\d{3}-\d{2}-\d{2}))(?![ .\-]?\d)",
    # Germany, and Britain's five and six digits.
    r"(?:(?:\+|00)(?:49|44)[ \-/]?(?:\(0\) ?)?|\(0|0)[1-9]\d{1,4}(?:\)[ \-/]{0,3}|[ \-/]{1,3})(?:\d{5,9}(?:-\d{1,5})?|\d{2,4}(?: \d{2,4}){1,3})(?![ \-]?\d)",
    r"0[1-9]\d{8,10}(?![.\-]?\d)",
    # America without separators.
    r"[2-9]\d{9}(?![.\-]?\d)",
    # Any other with a country.
    r"\+\d(?:[ .\-/]?\d){6,14}(?![.\-]?\d)",
]
#: Long strings in which letters of both cases and digits alternate; the longer, the fewer runs of digits are asked for.
_MIXED = r"(?=[A-Za-z0-9]*[a-z])(?=[A-Za-z0-9]*[A-Z])(?:(?=[A-Za-z]*[0-9]+[A-Za-z]+[0-9])[A-Za-z0-9]{20,}|(?=[A-Za-z]*[0-9])[A-Za-z0-9]{40,})"
_SECRETS = [
    r"(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{32,}",
    r"(?:AKIA|ASIA|AGPA|AIDA|AROA)[A-Z0-9]{16}",
    r"(?:sk|pk|rk)[_\-](?:[a-z]+[_\-])*[A-Za-z0-9_\-]{16,}",
    r"(?:gh[pousr]|github_pat|glpat|hf|npm|xox[abeprs]|dop_v1)[_\-][A-Za-z0-9_\-]{16,}",
    r"(?:AIza|ya29\.)[A-Za-z0-9_\-]{30,}",
    r"eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{4,}\.[A-Za-z0-9_\-]{16,}",
    r"(?<![+/])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z+/]*[0-9])[A-Za-z0-9+/]{40}(?![+/=])",
    _MIXED,
]
_HEX = "[0-9a-fA-F]{1,4}"
#: The number of a book: thirteen digits after 978 or 979, with or without its name.
_NO_ISBN = r"(?<!(?i:isbn(?:-1[03])?[ :]{1,2}))(?!97[89](?:[ \-]?\d){10}(?![ \-]?\d))"
#: Each stands for itself at any place of a text; no two kinds match the same string.
PATTERNS = {
    "email": rf"(?<![{_ALNUM}._%+\-])[{_ALNUM}._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{{2,}}",
    "ip": r"(?<![\d.])(?<!(?i:version|release|build|ver|rev|v)[ .:]{0,2})(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d])(?!\.\d)",
    "ip6": rf"(?<![\w:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?=(?:[0-9a-fA-F]*:){{3}})(?:{_HEX}(?::{_HEX})*)?::(?:{_HEX}(?::{_HEX})*)?)(?![\w:])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": rf"(?<![A-Za-z0-9])(?:{'|'.join(_SECRETS)})(?![A-Za-z0-9@])",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "phone": rf"(?<![\w+]){_NO_ISBN}(?:{_GROUPED}|(?<!\d[.\-])(?:{'|'.join(_PHONES)})(?![\p{{L}}_]))",
    "card": rf"(?<![\d.\-]){_NO_ISBN}\d(?:[ \-]?\d){{12,18}}(?![\d])",
    "person": rf"(?<![\p{{L}}])(?:{MALE}|{FEMALE}|{NEUTRAL})\.? {_NAME}(?: {_NAME}){{0,2}}",
}
#: What an entity of each kind starts with. Checked once at the start of a word, so that most places of a text cost one comparison.
STARTS = {"email": "", "ip": "(?=[0-9])", "ip6": "(?=[0-9a-fA-F]{0,4}:)", "iban": "(?=[A-Z]{2}[0-9])", "secret": r"(?=[A-Za-z0-9+/_\-]{18}|ya29|eyJ)", "ssn": "(?=[0-9])", "phone": "(?=[0-9+(])", "card": "(?=[0-9])", "person": "(?=[MHSDPFΚГг])"}
ENTITY = "(?<![A-Za-z0-9])(?:" + "|".join(f"{STARTS[k]}(?:{PATTERNS[k]})" for k in ("ip", "ip6", "iban", "secret", "ssn", "card", "phone", "person", "email")) + ")"


#: A word that may be a name mentioned again.
MENTION = rf"(?<![{_ALNUM}_]){_NAME}(?![{_ALNUM}_])"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


#: Beginnings, middles and endings of names, by script; endings by gender.
NAMES = {
    "latin": (["Ba", "Ce", "Da", "El", "Fa", "Go", "Ha", "Jo", "Ka", "Le", "Ma", "Ne", "Or", "Pa", "Ro", "Sa"], ["bi", "co", "dra", "fi", "le", "mo", "na", "ri", "sa", "ta", "ve", "zo", "lin", "mar", "ren", "tor"], {"f": "a", "m": "n", "x": "el", "s": "er"}),
    "cyrillic": (["Ба", "Ве", "Га", "Да", "Же", "За", "Ка", "Ле", "Ма", "Не", "Ор", "Па", "Ро", "Са", "Та", "Фе"], ["би", "во", "дра", "ки", "ле", "мо", "на", "ри", "са", "та", "ве", "зо", "лин", "мар", "рен", "тор"], {"f": "а", "m": "н", "x": "ий", "s": "ов"}),
    "greek": (["Αλ", "Βα", "Γε", "Δη", "Ελ", "Ζα", "Θε", "Κα", "Λε", "Μα", "Νι", "Πα", "Ρο", "Σα", "Τα", "Φα"], ["βι", "γο", "δρα", "κι", "λε", "μο", "να", "ρι", "σα", "τα", "ζο", "λιν", "μαρ", "ρεν", "τορ", "φι"], {"f": "α", "m": "ς", "x": "ι", "s": "ης"}),
}


def _digits(e: Column) -> Column:
    return F.regexp_replace(e, r"\D", "")


def _national(e: Column) -> Column:
    """The last ten digits of a phone number, without the country where a leading 0 stands for it at home."""
    digits = F.right(F.regexp_replace(e, r"^(?:\+|00)(?:33|34|44|49)|\D", ""), F.lit(10))
    return F.regexp_replace(digits, "^0(?=[0-9])", "")


def _luhn(number: Column) -> Column:
    return F.call_function("luhn_check", number)


def kind_of(e: Column) -> Column:
    """The first pattern that matches the whole entity."""
    out = F.lit("person")
    for kind in reversed([k for k in PATTERNS if k != "person"]):
        out = F.when(F.rlike(e, F.lit(f"^(?:{PATTERNS[kind]})$")), F.lit(kind)).otherwise(out)
    return out


def _gender(e: Column) -> Column:
    return F.when(F.rlike(e, F.lit(f"^(?:{MALE})\\.? ")), F.lit("m")).when(F.rlike(e, F.lit(f"^(?:{FEMALE})\\.? ")), F.lit("f")).otherwise(F.lit("x"))


def units_of(e: Column, kind: Column) -> Column:
    """Array of (kind, unit) that a surrogate depends on; one, or one for each name of a person."""
    one = lambda k, u: F.array(F.struct(F.lit(k).alias("kind"), u.alias("unit")))
    names = F.slice(F.split(e, " "), 2, 9)
    person = F.transform(
        names, lambda w, i: F.struct(F.when(i == F.size(names) - 1, F.lit("name_s")).otherwise(F.concat(F.lit("name_"), _gender(e))).alias("kind"), F.lower(w).alias("unit"))
    )
    return (
        F.when(kind == "person", person)
        .when(kind == "email", one("email", F.lower(e)))
        .when(kind == "phone", one("phone", _national(e)))
        .when(kind == "iban", one("iban", F.replace(e, F.lit(" "), F.lit(""))))
        .when(kind == "secret", one("secret", F.when(F.rlike(e, F.lit("^[0-9a-fA-F]+$")), F.lower(e)).otherwise(e)))
        .when(kind == "ip", one("ip", e))
        .when(kind == "ip6", one("ip6", F.lower(e)))
        .when(kind == "ssn", one("ssn", _digits(e)))
        .otherwise(one("card", _digits(e)))
    )


def _byte(h: Column, i: Column) -> Column:
    return F.conv(F.substr(h, (i % 31) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _like(s: Column, h: Column) -> Column:
    """Digits for digits and lower-case letters for letters, from the hash."""

    def char(c: Column, i: Column) -> Column:
        drawn = _byte(h, i) + F.floor(i / 31).cast("int") * 7
        return F.when(F.rlike(c, F.lit("[0-9]")), (drawn % 10).cast("string")).when(F.rlike(c, F.lit(r"\p{L}")), F.char(drawn % 26 + 97)).otherwise(c)

    return F.array_join(F.transform(F.split(s, ""), char), "")


def _hex_like(s: Column, h: Column) -> Column:
    return F.array_join(F.transform(F.split(s, ""), lambda c, i: F.when(c == ":", c).otherwise(F.lower(F.hex((_byte(h, i) + F.floor(i / 31).cast("int") * 5) % 16)))), "")


def _name(unit: Column, part: str, h: Column, attempt: Column) -> Column:
    """A name of four syllables, and of one more with every second attempt."""

    def of(script: str) -> Column:
        first, middle, ending = NAMES[script]
        pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), _byte(h, i) % len(xs) + 1)
        more = F.transform(F.sequence(F.lit(4), F.floor(attempt / 2).cast("int") + 3), lambda i: pick(middle, i))
        longer = F.when(attempt > 1, F.array_join(more, "")).otherwise("")
        return F.lower(F.concat(pick(first, F.lit(0)), *[pick(middle, F.lit(i)) for i in (1, 2, 3)], longer, F.lit(ending[part])))

    return F.when(F.rlike(unit, F.lit(r"\p{IsCyrillic}")), of("cyrillic")).when(F.rlike(unit, F.lit(r"\p{IsGreek}")), of("greek")).otherwise(of("latin"))


def _mod97(iban: Column) -> Column:
    """Remainder of an IBAN read as a number, its first four characters moved to the end."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.left(iban, F.lit(4)))
    value = lambda c: F.conv(c, 36, 10).cast("int")
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda acc, c: (acc * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)


def surrogate(kind: Column, unit: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a unit, in canonical form."""
    message = F.encode(F.concat_ws("\x1f", kind, unit, attempt.cast("string")), "utf-8")
    return let(_hmac(message, key), lambda h: _drawn(kind, unit, h, attempt))


def _hmac(message: Column, key: str) -> Column:
    """HMAC-SHA-256 in hexadecimal digits."""
    own = key.encode()
    own = (hashlib.sha256(own).digest() if len(own) > 64 else own).ljust(64, b"\0")
    inner = F.unhex(F.sha2(F.concat(F.lit(bytearray(b ^ 0x36 for b in own)), message), 256))
    return F.sha2(F.concat(F.lit(bytearray(b ^ 0x5C for b in own)), inner), 256)


def _drawn(kind: Column, unit: Column, h: Column, attempt: Column) -> Column:
    def card(digits: Column) -> Column:
        head = F.left(digits, F.length(digits) - 1)
        return let(head, lambda x: F.concat(x, F.filter(F.array(*[F.lit(str(d)) for d in range(10)]), lambda d: _luhn(F.concat(x, d)))[0]))

    country, check = F.left(unit, F.lit(2)), F.substr(unit, F.lit(3), F.lit(2))

    def iban(body: Column) -> Column:
        rest = 98 - _mod97(F.concat(country, F.lit("00"), body))
        valid = F.concat(country, F.lpad(rest.cast("string"), 2, "0"), body)
        return F.when(_mod97(unit) == 1, valid).otherwise(F.concat(country, _like(check, h), body))

    octet = lambda i: (_byte(h, F.lit(i)) % 254 + 1).cast("string")
    domain = (_byte(h, F.lit(29)) * 256 + _byte(h, F.lit(30))).cast("string")
    domain = F.when(attempt > 3, F.conv(F.substring(h, 45, 15), 16, 10)).otherwise(domain)
    email = F.concat(_like(F.substring_index(unit, "@", 1), h), F.lit("@mail"), domain, F.lit(".example.net"))
    out = F.when(kind == "email", email).when(kind == "ip", F.concat_ws(".", octet(0), octet(1), octet(2), octet(3)))
    out = out.when(kind == "iban", let(F.upper(_like(F.substr(unit, F.lit(5)), h)), iban)).when(kind == "secret", F.when(F.rlike(unit, F.lit("^[0-9a-f]+$")), _hex_like(unit, h)).otherwise(_like(unit, h)))
    out = out.when(kind == "ip6", _hex_like(unit, h))
    out = out.when((kind == "card") & _luhn(unit), let(_like(unit, h), card))
    for part in "fmxs":
        out = out.when(kind == f"name_{part}", _name(unit, part, h, attempt))
    return out.otherwise(_like(unit, h))


def _in_format(e: Column, s: Column) -> Column:
    """The characters of ``s`` in the places of the letters and digits of ``e``, in its case; those left over stand first as found."""
    count = F.length(F.regexp_replace(e, r"[^A-Za-z0-9]", ""))
    kept = count - F.length(s)

    def char(c: Column, i: Column) -> Column:
        at = F.length(F.regexp_replace(F.substr(e, F.lit(1), i + 1), r"[^A-Za-z0-9]", "")) - kept
        new = F.substr(s, at, F.lit(1))
        return F.when(~F.rlike(c, F.lit("[A-Za-z0-9]")) | (at < 1), c).when(F.rlike(c, F.lit("[A-Z]")), F.upper(new)).otherwise(new)

    return F.array_join(F.transform(F.split(e, ""), char), "")


def _resolved(u: Column, names: Column) -> Column:
    """A given name after a title that tells no gender is that of the document's person whose gender is told."""
    told = F.get(F.filter(names, lambda n: (n["unit"] == u["unit"]) & n["kind"].isin("name_f", "name_m")), F.lit(0))
    return F.when(u["kind"] == "name_x", F.coalesce(told, u)).otherwise(u)


def _replacement(e: Column, attempts: Column, key: str, names: Column) -> Column:
    attempt = lambda u: F.coalesce(F.element_at(attempts, F.concat_ws(":", u["kind"], u["unit"])), F.lit(0))
    drawn = lambda kind: F.transform(F.transform(units_of(e, kind), lambda u: _resolved(u, names)), lambda u: surrogate(u["kind"], u["unit"], attempt(u), key))
    return let(kind_of(e), lambda kind: let(drawn(kind), lambda d: _shown(e, kind, d)))


def _shown(e: Column, kind: Column, drawn: Column) -> Column:
    """The surrogates in the form of the entity."""
    words = F.split(e, " ")
    shown = F.transform(drawn, lambda s, i: F.when(F.upper(words[i + 1]) == words[i + 1], F.upper(s)).otherwise(F.initcap(s)))
    person = F.concat_ws(" ", words[0], F.array_join(shown, " "))
    first = drawn[0]
    # As long as the entity, and long texts of secrets take one pass.
    secret = F.zip_with(F.split(e, ""), F.split(first, ""), lambda c, n: F.when(F.rlike(c, F.lit("[A-Z]")), F.upper(n)).otherwise(n))
    return (
        F.when(kind == "person", person)
        .when(kind == "email", F.when((F.upper(e) == e), F.upper(first)).otherwise(first))
        .when(kind == "ip", first)
        .when(kind.isin("secret", "ip6"), F.array_join(secret, ""))
        .otherwise(let(first, lambda s: _in_format(e, s)))
    )


def entities(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ENTITY), 0)


def _names(found: Column) -> Column:
    """Array of (kind, unit) of the names found in a document; given names of a told gender come first."""
    return F.array_sort(F.flatten(F.transform(F.filter(found, lambda e: F.rlike(e, F.lit(f"^(?:{MALE}|{FEMALE}|{NEUTRAL})\\.? ")) & (kind_of(e) == "person")), lambda e: units_of(e, F.lit("person")))))


def _mentions(text: Column, names: Column, attempts: Column, key: str) -> Column:
    """The text between entities with each word replaced that is one of the names."""
    same = lambda w: F.filter(names, lambda n: n["unit"] == F.lower(w))
    attempt = lambda u: F.coalesce(F.element_at(attempts, F.concat_ws(":", u["kind"], u["unit"])), F.lit(0))
    cased = lambda w, s: F.when(F.upper(w) == w, F.upper(s)).otherwise(F.initcap(s))
    shown = lambda w, u: cased(w, surrogate(u["kind"], u["unit"], attempt(u), key))
    word = lambda w: let(same(w), lambda us: F.when(F.size(us) > 0, shown(w, us[0])).otherwise(w))
    between = F.split(text, MENTION, -1)
    joined = lambda b: F.concat(F.array_join(F.transform(F.regexp_extract_all(text, F.lit(MENTION), 0), lambda w, i: F.concat(b[i], word(w))), ""), F.element_at(b, -1))
    return let(between, joined)


def rewritten(text: Column, attempts: Column, key: str) -> Column:
    """The text with each entity and each further mention of its names replaced; all else stays as it is."""

    def joined(found: Column, names: Column) -> Column:
        part = lambda t: F.when((F.size(names) > 0) & (t != ""), _mentions(t, names, attempts, key)).otherwise(t)
        shown = lambda b: F.transform(found, lambda e, i: F.concat(part(b[i]), _replacement(e, attempts, key, names)))
        return let(F.split(text, ENTITY, -1), lambda b: F.concat(F.array_join(shown(b), ""), part(F.element_at(b, -1))))

    return let(entities(text), lambda found: F.when(F.size(found) > 0, let(_names(found), lambda names: joined(found, names))).otherwise(text))


def redrawn(units: DataFrame, key: str) -> DataFrame:
    """``kind, unit, attempt`` of the distinct units whose first surrogate is taken."""
    current = units.withColumn("attempt", F.lit(0))
    found = units.select("kind", F.col("unit").alias("s"), F.lit(True).alias("real"))
    for _ in range(ATTEMPTS):
        current = stage(current.withColumn("s", surrogate(F.col("kind"), F.col("unit"), F.col("attempt"), key)), "drawn")
        first = current.groupBy("kind", "s").agg(F.min("unit").alias("holder"))
        taken = stage(
            current.join(first, ["kind", "s"]).join(found, ["kind", "s"], "left").where("holder <> unit or real").select("kind", "unit").withColumn("again", F.lit(1)), "taken"
        )
        if taken.isEmpty():
            return current.where("attempt > 0").select("kind", "unit", "attempt")
        current = current.join(taken, ["kind", "unit"], "left").select("kind", "unit", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt"))
    raise RuntimeError(f"surrogates still collide after {ATTEMPTS} attempts")


def replace_pii(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates in ``text_col``; all other columns and rows as they were.

    ``key`` has no default, as surrogates under a public key can be traced back.
    Null texts stay null, texts without entities stay as they are. One entity has
    one surrogate in all documents, two entities never share one; a given name
    counts as one entity for each gender that its documents tell (or none). Rows may repeat
    or lack an id. An empty table gives an empty result.
    """
    marked = docs.select(F.col(id_col).alias("_id"), F.explode(entities(F.col(text_col))).alias("e"))
    held = marked.select("_id", F.explode(units_of(F.col("e"), kind_of(F.col("e")))).alias("u")).select("_id", "u.kind", "u.unit")
    held = stage(held.distinct(), "units")
    again = stage(redrawn(held.select("kind", "unit").distinct(), key), "redrawn")
    none = F.lit(None).cast("map<string,int>")
    if again.isEmpty():
        return docs.withColumn(text_col, rewritten(F.col(text_col), none, key))
    # A document has few units, and these are the few of them drawn again.
    by_doc = held.join(again, ["kind", "unit"]).groupBy("_id").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws(":", "kind", "unit"), "attempt"))).alias("attempts"))
    by_doc = stage(by_doc, "attempts")
    maybe, own_id, own = (free_name(docs, x) for x in ("_maybe", "_own_id", "_attempts"))
    flagged = bitmap.probe(docs, F.col(id_col), bitmap.build(by_doc, F.col("_id"), ID_BITS), ID_BITS, maybe)
    named = by_doc.select(F.col("_id").alias(own_id), F.col("attempts").alias(own))
    touched = flagged.where(F.col(maybe)).join(named, F.col(id_col).eqNullSafe(F.col(own_id)), "left").drop(own_id)
    both = flagged.where(~F.col(maybe)).withColumn(own, none).unionByName(touched)
    return both.withColumn(text_col, rewritten(F.col(text_col), F.col(own), key)).drop(maybe, own)


def op8_pii(spark, sf_dir: str) -> DataFrame:
    """Every document with its surrogates in place; ``changed`` says whether any was needed.

    The key is the setting ``spark.tessera.pii.key``; without one, a public key for tests.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.col("text").alias("source_text"))
    return replace_pii(docs, key=spark.conf.get("spark.tessera.pii.key", KEY)).select("doc_id", "text", (~F.col("text").eqNullSafe(F.col("source_text"))).alias("changed"))
