"""Column functions: codes, text, quotes, scores, hash randomness. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = "[ \\n\\t\\r\\f\\u000B]+"


def norm_audit(code: Column) -> Column:
    """Audit normalisation: no dots, trimmed, upper case."""
    return F.upper(F.trim(F.replace(code, F.lit("."), F.lit(""))))


def norm_model(code: Column) -> Column:
    """Normalisation of codes that a model wrote: trimmed and upper case, then no dots or spaces."""
    return F.translate(F.upper(F.trim(code)), ". ", "")


def parent(code: Column) -> Column:
    """Category: the first three characters without dots."""
    return F.substring(F.upper(F.replace(code, F.lit("."), F.lit(""))), 1, 3)


def tokens(text: Column) -> Column:
    """Lower-case white-space tokens; none for blank or null text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WS), lambda t: t != "")


def token_count(text: Column) -> Column:
    return F.size(tokens(text))


def words_longer_than(text: Column, n: int = 2) -> Column:
    """Distinct alphanumeric tokens of more than ``n`` characters."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) > n))


def overlap(needle: Column, haystack: Column) -> Column:
    """Share of the needle's words that the haystack has; 0 without words."""
    return share_of(words_longer_than(needle), words_longer_than(haystack))


def share_of(a: Column, b: Column) -> Column:
    """Share of the distinct words ``a`` that ``b`` has; 0 without words on either side, or where ``b`` is null."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, F.coalesce(b, F.array().cast("array<string>")))) / F.size(a)).otherwise(F.lit(0.0))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, WS, " "))


def preview(text: Column, n: int = 120) -> Column:
    return F.substring(collapse(F.coalesce(text, F.lit(""))), 1, n)


def verbatim(quote: Column, source: Column) -> Column:
    """Does the source hold the quote, whatever the case and white space? Null where either is blank or null."""
    q, s = F.lower(collapse(F.coalesce(quote, F.lit("")))), F.lower(collapse(F.coalesce(source, F.lit(""))))
    return F.when((q != "") & (s != ""), F.contains(s, q))


def chunks(text: Column, size: int = 256, overlap_: int = 32) -> Column:
    """Word windows of ``size`` tokens, ``size - overlap_`` apart; the last may be short. (Own design.)"""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), WS), lambda x: x != "")
    step = size - overlap_

    def cut(t: Column) -> Column:
        n = F.greatest(F.lit(1), F.ceil((F.size(t) - overlap_) / step).cast("int"))
        starts = F.when(F.size(t) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(t, i * step + 1, F.lit(size)), " "))

    return F.transform(F.array(words), cut)[0]  # bound once: the text would be split anew for every chunk


def sections(text: Column, headings: list[str]) -> Column:
    """array<struct<name, text>>: the text cut at lines that begin with one of the headings and a colon; what stands before the first has no name. Blank sections are left out."""
    any_ = "|".join("\\Q" + h + "\\E" for h in sorted(headings, key=len, reverse=True))
    names = F.concat(F.array(F.lit("")), F.regexp_extract_all(text, F.lit(rf"(?mi)^[ \t]*({any_})[ \t]*:"), F.lit(1)))
    parts = F.transform(F.split(text, rf"(?mi)^[ \t]*(?:{any_})[ \t]*:", -1), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.filter(F.zip_with(names, parts, lambda n, p: F.struct(n.alias("name"), p.alias("text"))), lambda s: F.coalesce(s["text"], F.lit("")) != "")


#: Two sentences of our own around a batch prompt's candidates, by template; only the request for quotes differs between the first two.
TEMPLATES = {
    "default": ("Judge each candidate code by the evidence given with it.\n\nCandidates:\n", "\n\nAnswer with a JSON list of one object a candidate: code, supported, confidence, q (a few words of the evidence), r."),
    "copy": ("Judge each candidate code by the evidence given with it.\n\nCandidates:\n", "\n\nAnswer with a JSON list of one object a candidate: code, supported, confidence, q (copied letter by letter from the evidence), r."),
    "note": ("Judge each candidate code by the note.\n\nNote:\n", "\n\nAnswer with a JSON list of one object a candidate: code, supported, confidence, q (a few words of the note), r."),
}


def prompt(candidates: Column, template: str = "default", note: Column | None = None, snippet_cap: int = 0, note_cap: int = 6000, cap: int = 0) -> Column:
    """A batch prompt from an array of (code, title, evidence): numbered candidates with evidence cut to ``snippet_cap`` characters, in template ``note`` after the first ``note_cap`` characters of the note, all cut to ``cap``. A cap of 0 is none."""
    cut = lambda c, n: F.substring(c, 1, n) if n else c
    none = F.lit("")
    line = lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(x["code"], none), F.lit(" ("), F.coalesce(x["title"], none), F.lit(")\n   Evidence: "), cut(F.coalesce(x["evidence"], none), snippet_cap))
    head, foot = TEMPLATES[template]
    parts = [F.lit(head), *([cut(F.coalesce(note, none), note_cap), F.lit("\n\nCandidates:\n")] if template == "note" else []), F.array_join(F.transform(candidates, line), "\n"), F.lit(foot)]
    return cut(F.concat(*parts), cap)


def section_key(name: Column) -> Column:
    return F.lower(F.translate(name, " -", "__"))


def weighted_query(sections: Column, cut: int = 500) -> Column:
    """Sections (array of name, text, weight): the first ``cut`` characters, max(1, round-half-even(weight)) times each."""
    part = F.transform(sections, lambda s: F.array_repeat(F.substring(s["text"], 1, cut), F.greatest(F.lit(1), F.bround(s["weight"], 0).cast("int"))))
    return F.array_join(F.flatten(part), " ")


def evidence_query(code: Column, title: Column, description: Column | None = None) -> Column:
    base = F.concat(F.lit("ICD-10 "), code, F.lit(": "), title)
    if description is None:
        return base
    d = F.substring(description, 1, 300)
    return F.when(description.isNotNull() & (description != "") & ~F.contains(title, description), F.concat(base, F.lit(" "), d)).otherwise(base)


def budgeted(parts: Column, most: int = 2000, least_tail: int = 100) -> Column:
    """Joins parts until ``most`` characters; a cut part is kept only where more than ``least_tail`` characters remain."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("used"), F.lit(False).alias("done"))

    def step(s: Column, p: Column) -> Column:
        left = F.lit(most) - s["used"]
        fits = F.length(p) <= left
        kept = F.when(s["done"], s["kept"]).when(fits, F.concat(s["kept"], F.array(p))).when(left > least_tail, F.concat(s["kept"], F.array(F.substr(p, F.lit(1), left)))).otherwise(s["kept"])
        return F.struct(kept.alias("kept"), F.when(s["done"] | ~fits, s["used"]).otherwise(s["used"] + F.length(p)).alias("used"), (s["done"] | ~fits).alias("done"))

    return F.aggregate(parts, start, step, lambda s: F.array_join(s["kept"], "\n"))


def sibling_list(text: Column) -> Column:
    return F.filter(F.split(text, "[,;\\s]+"), lambda x: x != "")


def token_budget(n: Column, cap: int) -> Column:
    return F.least(F.lit(120) + F.lit(40) * n, F.lit(cap))


def u32(*parts: Column | int | str) -> Column:
    """A whole number below 2**32 from the md5 of the parts joined by colons: the counter-based random source."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[c.cast("string") for c in cols])), 1, 8), 16, 10).cast("long")


def config_hash(items: dict[str, Column], n: int = 8) -> Column:
    """The first ``n`` digits of the MD5 of a configuration's JSON with sorted keys; ``items``: the JSON text of each key's value."""
    parts = [F.concat(F.lit(f'"{k}": '), items[k]) for k in sorted(items)]
    return F.substring(F.md5(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))), 1, n)


def sample_id(*parts: Column, n: int = 16) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, n)


def squash(score: Column) -> Column:
    """s / (1 + s), 0 for scores that aren't positive."""
    return F.when(score > 0, F.least(F.lit(1.0), score / (1 + score))).otherwise(F.lit(0.0))


def as_bool(text: Column) -> Column:
    """Three-valued: null where there is no judgement."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("true", "yes", "1", "supported"), True).when(t.isin("false", "no", "0", "unsupported"), False)


def as_confidence(text: Column) -> Column:
    """A number clamped to 0..1; 0 for NaN or no number. Whether one was given is ``has_confidence``."""
    x = text.try_cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def has_confidence(text: Column) -> Column:
    x = text.try_cast("double")
    return x.isNotNull() & ~F.isnan(x)


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return safe_ratio(2 * tp, 2 * tp + fp + fn)
