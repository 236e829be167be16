"""Surrogates for personal data, in DataFrame operations only.

Entities (e-mail and IP addresses, phone and card numbers, account and social-security numbers, secrets, and names: after a
title, or a known given name with a family name) are found by one pattern. Each is made of units: a name of its given names and its family name, an address of the
whole and its domain, others of one. A unit has a canonical form (digits of a number, lower case of a name or an address) and a
keyed surrogate of that form (a given name's depends on the family name too, so it is one person's): letters become letters of the same script, digits become digits, and everything else
stays; card numbers and IBANs keep right check digits, IP addresses stay in range, given names are drawn from lists of the
title's gender (or the given name's own) and the script. A mention is written by laying its units' surrogates over its format and case.

The surrogate is a function of the key and the unit, so all mentions agree across documents: whatever the format of a number, and with or without the
given name of a person. The distinct units of the whole corpus are
checked together, whatever their kind (given names within their family name): where the surrogates of two units are equal, or a surrogate is itself a unit (given names excepted, as lists hold real ones), all but
one take the next attempt, until none clashes. Only those exceptions are joined back to documents, by the hash of the text, so null and
repeated ids take part like others; the other units need no lookup.

Defined cases: null text stays null with 0 entities; texts of any length are replaced whole; repeated rows give equal
rows; an empty table gives an empty result; other columns are kept, but for ``n_entities``. Where the entities of a kind fill nearly all of its space (there
are 10**9 social-security numbers), attempts go on as long as they reduce the clashes; then the job ends with an error rather than with a shared surrogate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

# Title words by gender (n: either), and given names by script and gender (public knowledge, in natural order).
TITLES = {
    "m": ["Mr.", "Mr", "Herr", "Señor", "Sr.", "Monsieur", "г-н", "господин", "κ.", "κος", "Κύριος"],
    "f": ["Mrs.", "Mrs", "Ms.", "Ms", "Miss", "Frau", "Señora", "Sra.", "Madame", "г-жа", "госпожа", "κα", "Κυρία"],
    "n": ["Dr.", "Prof."],
}
NAMES = {
    "latin_m": ["Adam", "Albert", "Andrew", "Anton", "Bruno", "Carl", "Daniel", "David", "Edward", "Felix", "George", "Henry", "Hugo", "Ivan", "Jacob", "Joseph", "Leon", "Louis", "Martin", "Oscar", "Paul", "Peter", "Robert", "Simon", "Thomas", "Victor"],
    "latin_f": ["Ada", "Alice", "Anna", "Bella", "Clara", "Diana", "Elena", "Emma", "Eva", "Flora", "Grace", "Helen", "Ida", "Irene", "Julia", "Laura", "Lucy", "Maria", "Martha", "Nina", "Olga", "Rosa", "Sarah", "Sofia", "Vera", "Zoe"],
    "cyrillic_m": ["Алексей", "Андрей", "Борис", "Виктор", "Дмитрий", "Иван", "Михаил", "Николай", "Олег", "Павел", "Сергей", "Юрий"],
    "cyrillic_f": ["Алла", "Анна", "Вера", "Галина", "Елена", "Ирина", "Лидия", "Мария", "Нина", "Ольга", "Софья", "Татьяна"],
    "greek_m": ["Αλέξανδρος", "Γεώργιος", "Δημήτρης", "Ιωάννης", "Κώστας", "Νίκος", "Πέτρος", "Στέφανος"],
    "greek_f": ["Άννα", "Δήμητρα", "Ελένη", "Ειρήνη", "Ιωάννα", "Κατερίνα", "Μαρία", "Σοφία"],
}
_GIVEN = {g: sorted({n for k, v in NAMES.items() if k.endswith(g) for n in v}) for g in "mf"}
_TITLE = "|".join(sorted({t.replace(".", "\\.") for v in TITLES.values() for t in v}, key=len, reverse=True))
_KNOWN = "|".join(sorted({*_GIVEN["m"], *_GIVEN["f"]}, key=len, reverse=True))
#: A name's word: capital first, letters, apostrophes and hyphens (also with capitals inside, as in O'Neil, McDonald, DeVries), a small letter last; or capitals only. A possessive 's isn't part of it.
_WORD = r"(?:\p{Lu}(?:(?!['\x{2019}]s(?!\p{L}))[\p{L}\x{2019}'-])*\p{Ll}|\p{Lu}(?:['\x{2019}-]?\p{Lu}){2,})"
_BEFORE = r"(?=[\p{Lu}гκ])(?<![\p{L}\p{N}_])"  #: a word begins, with a letter that titles and names begin with
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|(?:AKIA|ghp_|sk-)[0-9A-Za-z]{16,48})(?![0-9A-Za-z])|(?<=[=:])(?<=(?:password|passwd|secret|token|api_key)[=:])[0-9A-Za-z]{6,64}(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<!\w)\(\d{3}\) ?\d{3}-\d{4}(?!\w)|(?<![\w-])\d{3}-\d{3}-\d{4}(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w-])\d{4}(?:[ -]?\d{4}){3}(?![\w-])|(?<![\w-])\d{4}[ -]?\d{6}[ -]?\d{5}(?![\w-])",
    "name": rf"{_BEFORE}(?:{_TITLE}) {_WORD}(?: {_WORD}){{0,2}}|{_BEFORE}(?:{_KNOWN}) {_WORD}",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Text that can hold an entity has a digit, an address, a title or a known name; others are left alone without a search.
HINT = rf"[\d@]|[=:][0-9A-Za-z]{{6}}|{_BEFORE}(?:{_TITLE}|{_KNOWN}) \p{{Lu}}"
LONGER = 6  #: from this attempt on names and addresses, whose space may be small, get letters more

# The alphabets from which letters and digits are drawn.
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзийклмнопрстуфхцчшщэюя", "αβγδεζηθικλμνξοπρστυφχψω", "àáâäåèéêëíîïñòóôöùúûü"]
CLASSES = ["[0-9]", "[a-z]", "[A-Z]", "[а-яё]", "[α-ωά-ώ]", "[ß-öø-ÿœšž]"]


def entity_type(e: Column) -> Column:
    """The type of a found entity: the first whose pattern it matches as a whole, else a secret (found by the word before it)."""
    out = F.lit("secret")
    for k, p in reversed(PATTERNS.items()):
        simple = {"email": F.instr(e, "@") > 0, "name": e.rlike(rf"^(?:{_TITLE}|{_KNOWN}) ")}.get(k, e.rlike(f"^(?:{p})$"))
        out = F.when(simple, F.lit(k)).otherwise(out)
    return out


def _digits_of(e: Column) -> Column:
    return F.regexp_replace(e, r"\D", "")


def _words(e: Column) -> Column:
    """The given names and the family name of a name, without its title."""
    return F.split(F.regexp_replace(e, rf"^(?:{_TITLE}) ", ""), " ")


def _gender(e: Column) -> Column:
    title, first = F.regexp_extract(e, rf"^(?:{_TITLE})(?= )", 0), _words(e)[0]
    return F.when(title.isin(TITLES["f"]), "f").when(title.isin(TITLES["m"]), "m").when(first.isin(_GIVEN["f"]), "f").otherwise("m")


def units(e: Column, kind: Column) -> Column:
    """The units (kind, canon) of a mention; what mentions of one unit have in common is its canon."""
    unit = lambda k, c: F.struct((F.lit(k) if isinstance(k, str) else k).alias("kind"), c.alias("canon"))
    digits, words = _digits_of(e), _words(e)
    one = F.when(kind == "phone", F.substring(digits, -10, 10)).when(kind.isin("ssn", "card"), digits).when(kind == "iban", F.regexp_replace(e, " ", "")).otherwise(e)
    last = F.size(words) - 1
    return (
        F.when(kind == "name", F.transform(words, lambda w, i: F.when(i < last, unit(F.concat(F.lit("given "), _gender(e)), F.concat(F.lower(w), F.lit(" "), F.lower(F.element_at(words, -1))))).otherwise(unit("family", F.lower(w)))))
        .when(kind == "email", F.array(unit("email", F.lower(e)), unit("domain", F.regexp_extract(F.lower(e), "@(.*)$", 1))))
        .otherwise(F.array(unit(kind, one)))
    )


def _stream(key: Column, kind: Column, canon: Column, attempt: Column) -> Column:
    """Hexadecimal digit pairs that follow from the key and the unit: more than the unit has characters."""
    block = lambda i: F.sha2(F.concat_ws("\u001f", key, kind, canon, attempt.cast("string"), i.cast("string"), key), 512)
    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.length(canon) + 20) / 64).cast("int")), block), "")


def _number(stream: Column, i: Column) -> Column:
    """The i-th (from 1) number 0 to 255 of the stream."""
    return F.conv(F.substr(stream, (2 * i - 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _letters(e: Column, stream: Column, lead: int = 0) -> Column:
    """Each letter or digit from position ``lead`` + 1 on replaced by one of its class."""

    def one(c: Column, i: Column) -> Column:
        n = _number(stream, i + 1)
        out = c
        for alphabet, kind in list(zip(ALPHABETS, CLASSES, strict=True))[::-1]:
            out = F.when(c.rlike(f"^{kind}$"), F.substr(F.lit(alphabet), (n % len(alphabet) + 1).cast("int"), F.lit(1))).otherwise(out)
        return F.when(i < lead, c).otherwise(out) if lead else out

    return F.array_join(F.transform(F.split(e, ""), one), "")


def _luhn(d: Column) -> Column:
    """The check sum (modulo 10) of an array of digits, the last of which is not doubled."""
    return F.aggregate(F.transform(F.reverse(d), lambda x, i: F.when(i % 2 == 0, x).when(2 * x > 9, 2 * x - 9).otherwise(2 * x)), F.lit(0), lambda a, x: a + x) % 10


def _mod97(text: Column) -> Column:
    """The remainder of a string of digits and capital letters (10 to 35) modulo 97."""
    value = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.transform(F.split(text, ""), value), F.lit(0), lambda a, x: F.when(x < 10, (a * 10 + x) % 97).otherwise((a * 100 + x) % 97))


def _number_of(canon: Column, kind: Column, stream: Column) -> Column:
    """New digits for a number: a card keeps its first digit and a right check digit; area and exchange codes begin with 2 to 9."""
    old = F.transform(F.split(canon, ""), lambda c: c.cast("int"))
    new = F.transform(old, lambda d, i: F.when((kind == "phone") & ((i == 0) | (i == 3)), F.lit(2) + _number(stream, i + 1) % 8).when((kind == "card") & (i == 0), d).otherwise(_number(stream, i + 1) % 10))
    head = F.slice(new, 1, F.greatest(F.lit(0), F.size(new) - 1))
    right = F.concat(head, F.array((10 - _luhn(F.concat(head, F.array(F.lit(0))))) % 10))
    return F.array_join(F.transform(F.when((kind == "card") & (_luhn(old) == 0), right).otherwise(new), lambda d: d.cast("string")), "")


def _iban(canon: Column, stream: Column) -> Column:
    """The country, check digits and a new account; the check digits are right where the old ones are."""
    new, country, account = _letters(canon, stream, 2), F.substr(canon, F.lit(1), F.lit(2)), F.lit(5)
    rest = F.substr(new, account)
    check = F.lpad((98 - _mod97(F.concat(rest, country, F.lit("00")))).cast("string"), 2, "0")
    valid = _mod97(F.concat(F.substr(canon, account), F.substr(canon, F.lit(1), F.lit(4)))) == 1
    return F.when(valid, F.concat(country, check, rest)).otherwise(new)


def _given(canon: Column, kind: Column, stream: Column, attempt: Column) -> Column:
    """A listed name of the unit's gender and script. The lists are short: from the second attempt on, made letters lengthen it."""
    script = F.when(canon.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(canon.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")
    out = F.lit(None).cast("string")
    for k, names in NAMES.items():
        pick = F.element_at(F.array(*(F.lit(n.lower()) for n in names)), ((_number(stream, F.lit(1)) * 256 + _number(stream, F.lit(2))) % len(names) + 1).cast("int"))
        out = F.when((script == k[:-2]) & (kind == f"given {k[-1]}"), pick).otherwise(out)
    tail = F.when(script == "cyrillic", "абвгде").when(script == "greek", "αβγδεζ").otherwise("abcdef")
    return F.when(attempt == 0, out).otherwise(F.concat(out, _letters(tail, F.substr(stream, F.lit(21), F.lit(40)))))


def canonical_surrogate(u: Column) -> Column:
    """The surrogate of a unit (kind, canon, attempt, stream) in canonical form."""
    kind, canon, stream = u["kind"], u["canon"], u["stream"]
    more = F.when(u["attempt"] >= LONGER, _letters(F.when(canon.rlike(r"^\p{IsCyrillic}"), "абвг").when(canon.rlike(r"^\p{IsGreek}"), "αβγδ").otherwise("abcd"), F.reverse(stream))).otherwise("")
    octets = F.transform(F.split(canon, r"\."), lambda c, i: F.when(i == 0, 1 + _number(stream, F.lit(1)) % 223).otherwise(1 + _number(stream, i + 1) % 254).cast("string"))
    hexes = F.transform(F.split(canon, ""), lambda c, i: F.substr(F.lit("0123456789abcdef"), (_number(stream, i + 1) % 16 + 1).cast("int"), F.lit(1)))
    return (
        F.when(kind.isin("phone", "ssn", "card"), _number_of(canon, kind, stream))
        .when(kind == "ip", F.array_join(octets, "."))
        .when((kind == "secret") & canon.rlike("^[0-9a-f]+$"), F.array_join(hexes, ""))
        .when((kind == "secret") & canon.rlike("^(?:AKIA|ghp_|sk-)"), _letters(canon, stream, 4))
        .when(kind == "iban", _iban(canon, stream))
        .when(kind == "email", F.concat(_letters(F.regexp_extract(canon, "^[^@]*", 0), stream), more, F.regexp_extract(canon, "@.*$", 0)))
        .when(kind == "domain", F.concat(_letters(F.regexp_extract(canon, r"^(.*)\.[^.]*$", 1), stream), more, F.regexp_extract(canon, r"\.[^.]*$", 0)))
        .when(kind.startswith("given"), _given(canon, kind, stream, u["attempt"]))
        .otherwise(F.concat(_letters(canon, stream), more))
    )


def _surrogates_of(array: Column, key: Column, attempt) -> Column:
    """Units with attempt, stream and ``s``, their surrogate; ``attempt`` maps a unit to its attempt. Each stage is a transform of its own, so what it makes is made once."""
    out = F.transform(array, lambda u: u.withField("attempt", attempt(u)))
    out = F.transform(out, lambda u: u.withField("stream", _stream(key, u["kind"], u["canon"], u["attempt"])))
    return F.transform(out, lambda u: u.withField("s", canonical_surrogate(u)))


def _over(e: Column, new: Column, skip: Column, place: str) -> Column:
    """The mention with its characters of class ``place`` replaced in turn by those of ``new``; the first ``skip`` of them (a country code) stay."""

    def step(s: Column, c: Column) -> Column:
        fits = c.rlike(place)
        put = F.when(s["n"] < s["skip"], c).otherwise(F.substr(s["new"], (s["n"] - s["skip"] + 1).cast("int"), F.lit(1)))
        return F.struct(F.concat(s["t"], F.when(fits, put).otherwise(c)).alias("t"), (s["n"] + fits.cast("int")).alias("n"), s["skip"].alias("skip"), s["new"].alias("new"))

    start = F.struct(F.lit("").alias("t"), F.lit(0).alias("n"), skip.alias("skip"), new.alias("new"))
    return F.aggregate(F.split(e, ""), start, step, lambda s: s["t"])


def _cased(word: Column, new: Column) -> Column:
    """``new`` (lower case) with capitals where the word has them; all capitals, where it has nothing else."""
    whole = (word == F.upper(word)) & (F.length(word) > 1)
    upper = lambda i: (F.substr(word, (i + 1).cast("int"), F.lit(1)) != F.lower(F.substr(word, (i + 1).cast("int"), F.lit(1)))) & (i < F.length(word))
    return F.when(whole, F.upper(new)).otherwise(F.array_join(F.transform(F.split(new, ""), lambda c, i: F.when(upper(i), F.upper(c)).otherwise(c)), ""))


def _written(m: Column) -> Column:
    """A mention (e, kind, units with their surrogates) in its own format."""
    e, kind, first = m["e"], m["kind"], m["units"][0]["s"]
    title = F.regexp_extract(e, rf"^(?:{_TITLE}) ", 0)
    name = F.array_join(F.zip_with(_words(e), m["units"], lambda w, u: _cased(w, u["s"])), " ")
    local = F.regexp_extract(first, "^[^@]*", 0)
    domain = F.element_at(m["units"], -1)["s"]
    return (
        F.when(kind == "name", F.concat(title, name))
        .when(kind == "email", F.concat(_cased(F.regexp_extract(e, "^[^@]*", 0), local), F.lit("@"), _cased(F.regexp_extract(e, "@(.*)$", 1), domain)))
        .when(kind.isin("phone", "ssn", "card"), _over(e, first, F.length(_digits_of(e)) - F.length(first), "[0-9]"))
        .when(kind == "iban", _over(e, first, F.lit(0), "[0-9A-Z]"))
        .otherwise(first)
    )


def surrogates(mentions: Column, key: Column, attempt) -> Column:
    """For each mention of an array: (e, kind, units, s) with its replacement ``s``."""
    with_ = lambda array, name, f: F.transform(array, lambda m: m.withField(name, f(m)))
    out = F.transform(mentions, lambda e: F.struct(e.alias("e"), entity_type(e).alias("kind")))
    out = with_(out, "units", lambda m: units(m["e"], m["kind"]))
    out = with_(out, "units", lambda m: _surrogates_of(m["units"], key, attempt))
    return with_(out, "s", _written)


def find(text: Column) -> Column:
    """All entity mentions of a text, in order."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def attempts(mentions: DataFrame, key: str, scratch: Scratch, patience: int = 8) -> DataFrame:
    """(kind, canon, attempt) of the units whose first surrogate clashes. ``mentions``: a column e of distinct mentions.

    An error follows ``patience`` rounds one after the other without fewer clashes.
    """
    given = F.col("kind").startswith("given")
    ents = mentions.select(F.explode(units(F.col("e"), entity_type(F.col("e")))).alias("u")).select("u.kind", "u.canon").distinct().withColumn("attempt", F.lit(0))
    ents, least, vain = scratch.save(ents, "units"), None, 0
    real = ents.where(~given).select(F.col("canon").alias("real")).distinct()
    while True:
        u = F.array(F.struct("kind", "canon"))
        made = ents.withColumn("s", F.element_at(_surrogates_of(u, F.lit(key), lambda _: F.col("attempt")), 1)["s"])
        made = scratch.save(made.withColumn("space", F.when(given, F.concat(F.lit("given "), F.substring_index("canon", " ", -1))).otherwise("")), "made")
        taken = made.groupBy("space", "s").agg(F.count("*").alias("n"), F.min(F.struct("attempt", "kind", "canon")).alias("keep")).where("n > 1")
        again = made.join(taken, ["space", "s"]).where("kind <> keep.kind or canon <> keep.canon").select("kind", "canon")
        again = again.unionByName(made.where("space = ''").join(real, F.col("s") == F.col("real"), "left_semi").select("kind", "canon")).distinct()
        again = scratch.save(again, "clashes")
        n = again.count()
        scratch.drop(made)
        if not n:
            scratch.drop(again)
            return ents.where("attempt > 0")
        vain = 0 if least is None or n < least else vain + 1
        least = n if least is None else min(n, least)
        if vain >= patience:
            raise RuntimeError(f"{n} surrogates still clash: the entities fill the space of their kind")
        ents = scratch.save(ents.join(again.withColumn("more", F.lit(1)), ["kind", "canon"], "left").select("kind", "canon", (F.col("attempt") + F.coalesce("more", F.lit(0))).alias("attempt")), "units")
        scratch.drop(again)


def replace(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with the entities of ``text`` replaced, and n_entities, the number of mentions."""
    scratch = Scratch(docs.sparkSession, "pii")
    hash_, found_, tries = "__pii_text__", "__pii_found__", "__pii_attempts__"
    found, unit_key = find(F.col(text)), lambda u: F.concat_ws("\u001f", u["kind"], u["canon"])
    mentions = docs.select(F.explode(F.array_distinct(found)).alias("e")).distinct()
    odd = scratch.save(attempts(mentions, key, scratch), "exceptions")
    rows = docs.drop("n_entities").withColumn(found_, found)
    if odd.limit(1).count():
        each = docs.select(F.xxhash64(F.col(text)).alias(hash_), F.explode(F.array_distinct(found)).alias("e")).select(hash_, F.explode(units(F.col("e"), entity_type(F.col("e")))).alias("u")).distinct()
        each = each.select(hash_, "u.kind", "u.canon").join(odd, ["kind", "canon"])
        by = each.groupBy(hash_).agg(F.map_from_entries(F.collect_set(F.struct(unit_key({"kind": F.col("kind"), "canon": F.col("canon")}).alias("k"), F.col("attempt")))).alias(tries))
        rows = rows.withColumn(hash_, F.xxhash64(F.col(text))).join(by, hash_, "left").drop(hash_)
    else:
        rows = rows.withColumn(tries, F.lit(None).cast("map<string,int>"))
    new = F.transform(surrogates(F.col(found_), F.lit(key), lambda u: F.coalesce(F.try_element_at(tries, unit_key(u)), F.lit(0))), lambda m: m["s"])
    gaps = F.split(text, PATTERN, -1)
    whole = F.array_join(F.zip_with(gaps, new, lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), "")
    rows = rows.withColumn(text, F.when(F.size(found_) > 0, whole).otherwise(F.col(text))).withColumn("n_entities", F.greatest(F.coalesce(F.size(found_), F.lit(0)), F.lit(0)))
    return rows.select(*docs.drop("n_entities").columns, "n_entities")
