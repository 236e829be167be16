"""Filter audit, url rules and source divergence against brute force, SQL and their edge cases."""

import collections
import itertools
import random
import re

import duckdb
import numpy as np
import pytest

from auditloom.llm import queries, source_divergence, url_automaton, walsh_audit
from auditloom.llm.oracles import ORACLES

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, part string, n long, label string, mask int"
LABELS = "doc_id long, quality int, toxic int, part string, n long"


def docs(spark, rows):
    """(id, text, lang, source) with columns whose names clash with inner ones."""
    return spark.createDataFrame([(*r, "p", 7, "x", 3) for r in rows], DOCS)


@pytest.mark.parametrize("name", ["op11_walsh_audit", "op12_url_automaton", "op13_source_divergence"])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df = queries.queries()[name](spark, DIR)
    rel = con.execute(ORACLES[name])
    cols = [c[0] for c in rel.description]
    assert sorted(cols) == sorted(df.columns)
    want, got = collections.Counter(rel.fetchall()), collections.Counter(map(tuple, df.select(*(f"`{c}`" for c in cols)).collect()))
    assert got == want and got


# 11 ---------------------------------------------------------------------------------------------------------------


def audit_by_hand(rows, labels):
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    first = {}
    for i, t, _, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    docs_ = []
    for i, t, _, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {k for k, bad in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and first[t] < i), strict=True) if bad}
        docs_.append((s or "", fails, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs_}:
        own = [d[1:] for d in docs_ if d[0] == part]
        total = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = list(own)
            for k, letter in enumerate(order):
                gone = [d for d in left if letter in d[0]]
                left = [d for d in left if letter not in d[0]]
                out[part, "".join(order), k + 1] = [len(left), len(gone), sum(letter in d[0] and bool(d[0] & set(order[:k])) for d in own), sum(d[0] == {letter} for d in own), sum(d[1] for d in gone), sum(d[2] for d in gone)]
                total[letter] += len(gone)
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit_by_hand(spark):
    rng = random.Random(1)
    long_ = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None, "en", "a"), (2, "", "en", None), (3, long_, "en", "a"), (4, long_, "de", "b"), (4, long_, "de", "b"), (3, long_, "en", "a"), (None, long_, "en", "a"), (None, None, None, ""), (5, "A" * 200, "en", "c"), (6, "w " * 30000, "en", "c"), (7, "É" + long_ + " #", "en", "a"), (8, "x\x0by\x1cz " * 60, "fr", "b")]
    rows += [(100 + k, " ".join(rng.choice(["a", "B", "c%", f"d{rng.randrange(99)}"]) for _ in range(rng.randrange(120))), "en", rng.choice(["a", "b"])) for k in range(40)]
    labels = [(3, 1, 0), (3, 0, 1), (4, None, 1), (6, 1, None), (999, 1, 1), (None, 1, 1)] + [(100 + k, k % 2, k % 3 == 0) for k in range(40)]
    got = walsh_audit.audit(docs(spark, rows), spark.createDataFrame([(i, q, None if t is None else int(t), "x", 1) for i, q, t in labels], LABELS))
    want = audit_by_hand(rows, labels)
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got.collect()} == want
    assert len(want) == got.count() == 600 * len({p for p, _, _ in want})


def test_transform_inverts(spark):
    rng = random.Random(2)
    rows = [("p", rng.random() < 0.5, rng.random() < 0.5, m, rng.randrange(1, 10**12)) for m in range(32) for _ in range(2)]
    counted = spark.createDataFrame(rows, "part string, good boolean, toxic boolean, mask int, n long")
    r = walsh_audit.mask_cells(walsh_audit.parity_sums(counted)).first()
    for name, keep in (("all", lambda x: True), ("good", lambda x: x[1]), ("toxic", lambda x: x[2])):
        assert list(r[name]) == [sum(x[4] for x in rows if x[3] == m and keep(x)) for m in range(32)]


def test_audit_of_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    assert walsh_audit.audit(docs(spark, []), none).collect() == []
    r = walsh_audit.audit(docs(spark, [(1, "one two", "en", "s")]), none).where("filter_order = 'ABCDE'").orderBy("step").collect()
    assert [(x.kept, x.removed, x.good_lost) for x in r] == [(0, 1, 0)] + [(0, 0, 0)] * 4 and r[0].shapley == 120


# 12 ---------------------------------------------------------------------------------------------------------------


def glob_regex(glob):
    out, at = "", 0
    while at < len(glob):
        if glob.startswith("**", at):
            out, at = out + ".*", at + 2
        elif glob[at] in "*?":
            out, at = out + ("[^/]*" if glob[at] == "*" else "[^/]"), at + 1
        else:
            at += glob[at] == "\\" and at + 1 < len(glob)
            out, at = out + re.escape(glob[at]), at + 1
    return re.compile(out, re.S)


def cut(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])


@pytest.mark.parametrize("few", [0, 24])
def test_automaton_matches_regular_expressions(monkeypatch, few):
    monkeypatch.setattr(url_automaton, "FEW", few)
    rng = random.Random(3)
    pick = lambda of, n: "".join(rng.choice(of) for _ in range(rng.randrange(n)))
    globs = ["", "*", "**", "?", "\\*", "a*b", "*a", "a**", "**/b?", "\\", "é?", "**é", "*" * 3] + [pick(["a", "b", "/", "*", "**", "?", "é", "\\*", "\U0001f600"], 9) for _ in range(90)]
    groups = [globs[k : k + 2] for k in range(0, len(globs), 2)]
    texts = ["", "a", "/", "é", "*"] + [pick(["a", "b", "/", "é", "*", "\U0001f600"], 12) for _ in range(400)] + ["a" * 3000 + "/b"]
    machine = url_automaton.Automaton(groups)
    assert machine.words > 3  # patterns cross the bounds of words
    got = machine.matches(*cut(texts))
    assert got.tolist() == [[any(glob_regex(g).fullmatch(t) for g in gs) for gs in groups] for t in texts]


def test_urls_by_hand(spark):
    rows = {
        1: ("http://example.com/en/x", "example.com", "/en/x", "example.com/en/", "block"), 2: ("https://WWW.Example.COM/en/?q", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        3: ("x://a.b.example.com/en/#t", "a.b.example.com", "/en/", "example.com/en/", "block"), 4: ("http://myexample.com/en/", "myexample.com", "/en/", "com/", "allow"),
        5: ("http://example.com/EN/", "example.com", "/EN/", "com/", "allow"), 6: ("http://example.com", "example.com", "", None, "allow"), 7: ("http://a.net/es/1", "a.net", "/es/1", "net/es/", "block"),
        8: ("http://a.net/x/y.com/en/", "a.net", "/x/y.com/en/", None, "allow"), 9: ("http://spam-farm.org/", "spam-farm.org", "/", None, "block"), 10: ("http://a.org/spam", "a.org", "/spam", None, "allow"),
        11: (None, "", "", None, "allow"), 12: ("no scheme.com/en/", "", "", None, "allow"), 13: ("", "", "", None, "allow"), 14: ("http://?com/", "", "", None, "allow"),
        15: ("http://net:80/fr/", "net:80", "/fr/", None, "allow"), 16: ("a://b://example.net/fr/x", "b:", "//example.net/fr/x", None, "allow"), 17: ("http://É.com/\nx", "É.com", "/\nx", "com/", "allow"),
        18: ("http://x.spam.com/", "x.spam.com", "/", "com/", "allow"), 19: ("http://cheap-pills.org", "cheap-pills.org", "", None, "block"), 20: ("http://a.com/" + "y/" * 50000, "a.com", "/" + "y/" * 50000, "com/", "allow"),
    }
    schema = "page_id long, url string, html string, host string, path string, rule string, canonical string"
    pages = spark.createDataFrame([(i, v[0], None, "h", "p", "r", "c") for i, v in rows.items()] + [(1, rows[1][0], "x", "h", "p", "r", "c"), (None, rows[7][0], "", "", "", "", "")], schema)
    got = url_automaton.judge(pages).collect()
    assert sorted((r for r in map(tuple, got) if r[0] is not None), key=lambda r: r[0]) == sorted([(i, *v[1:]) for i, v in rows.items()] + [(1, *rows[1][1:])], key=lambda r: r[0])
    assert [tuple(r)[1:] for r in got if r.page_id is None] == [rows[7][1:]]
    assert url_automaton.judge(spark.createDataFrame([], schema)).collect() == []


def test_rules_of_equal_length(spark):
    pages = spark.createDataFrame([(1, "http://b.com/x/")], "page_id long, url string")
    rules = [("block", "com", "/x/"), ("allow", "b.com", "/"), ("block", "b.com", "/")]
    assert url_automaton.judge(pages, rules).first().verdict == "allow"  # the longer host, then the earlier rule
    assert url_automaton.judge(pages, [("block", "com", "")]).first().rule == "com"  # without a path: any path
    assert url_automaton.judge(pages, [], []).first().verdict == "allow"
    assert url_automaton.judge(pages, [("block", "b?com", "/"), ("block", "*", "")], []).first().rule is None  # rules are literal


# 13 ---------------------------------------------------------------------------------------------------------------


def divergence_by_hand(rows, least, top):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    d = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(low))) for _, t, lang, source in rows]
    out = []
    for lang in {x[0] for x in d}:
        df = collections.Counter(t for x in d if x[0] == lang for t in set(x[2]))
        kept = {t for t, n in df.items() if n >= least}
        count = {s: collections.Counter(t for x in d if x[:2] == (lang, s) for t in x[2] if t in kept) for s in {x[1] for x in d if x[0] == lang}}
        whole = sum(count.values(), collections.Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        q = p(whole)
        for s, c in count.items():
            own = p(c)
            pairs = [(-sum(abs(own[t] - p(o)[t]) for t in kept), x.encode()) for x, o in count.items() if x != s]
            terms = [(q[t] - own[t], t.encode()) for t in kept if c[t] and own[t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, i.decode(), -v, k + 1) for k, (v, i) in enumerate(found)]
    return sorted(out)


EDGE = [(1, None, None, None), (2, "", "en", "empty"), (3, "12 34 _ [", "en", "signs"), (4, "Straße ÀÉ \U0001f600x e\x00f", "xx", "only"), (5, "word " * 60000 + "z" * 3_000_000, "en", "long"), (5, "Same same", "en", "a"), (5, "Same same", "en", "a"), (None, "no id", "en", "b"), (6, "a é ö", "en", "é")]


@pytest.mark.parametrize(("least", "top", "bits", "held"), [(1, 3, 22, 200_000), (4, 50, 22, 3), (4, 50, 4, 50), (10**6, 50, 8, 9)])
def test_divergence_by_hand(spark, least, top, bits, held):
    """A crowded sketch lets through more, and the result is the same."""
    rng = random.Random(4)
    rows = EDGE + [(10 + k, " ".join(rng.choice("abcdefgHIJ") * rng.randrange(1, 3) for _ in range(rng.randrange(30))), rng.choice(["en", "de"]), rng.choice("abcd")) for k in range(120)]
    got = sorted(map(tuple, source_divergence.divergence(docs(spark, rows), least=least, top=top, bits=bits, most=held).collect()))
    assert got == divergence_by_hand(rows, least, top)


def test_sketch_never_underestimates(spark):
    rng = random.Random(5)
    rows = [(k, " ".join("".join(rng.choice("abcd") for _ in range(3)) for _ in range(20)), "en", "s") for k in range(80)]
    d = docs(spark, rows).select("lang", "source", "text").repartition(5)
    table = source_divergence.sketch(d, 12, 6)
    df = collections.Counter(t for r in rows for t in set(r[1].split()))
    assert all(table[source_divergence.cells(b"en", [t.encode()], 6)].min() >= min(12, n) for t, n in df.items())
    assert table.max() <= 12


def test_divergence_of_an_empty_table(spark):
    assert source_divergence.divergence(docs(spark, [])).collect() == []


def test_term_lists_cut_after_separators():
    rng = random.Random(6)
    text = "".join(rng.choice(["ab", "É", " ", "1", "Z"]) for _ in range(5000)).encode()
    want = re.findall(rb"[a-z\x80-\xff]+", text.lower())
    for part in (1, 7, 100, 10**6):
        assert [t for ts in source_divergence.term_lists(text, part) for t in ts] == want


# Mended in earlier operators ---------------------------------------------------------------------------------------


def test_language_of_rows_without_ids_or_with_one(spark):
    from auditloom.llm import language_id

    rng = random.Random(7)
    words = {"en": ["the", "house", "is", "green", "and", "old"], "de": ["das", "haus", "ist", "grün", "und", "alt"]}
    text = lambda lang: " ".join(rng.choice(words[lang]) for _ in range(12))
    for ids in ([None] * 3000, [9] * 3000):
        rows = [(i, text(lang), lang, "s") for i, lang in zip(ids, itertools.cycle(words), strict=False)]
        d = docs(spark, rows)
        trees = language_id.learn(d, fold=(3, 7))
        assert trees.languages == ["de", "en"]
        got = language_id.identify(d.limit(50), trees).collect()
        assert all(r.lang_pred in words for r in got)
    same = docs(spark, [(k % 2 and None, "the same text every time", "en", "s") for k in range(2000)])
    assert language_id.learn(same, fold=(3, 7)).languages == ["en"]
    none = docs(spark, [(1, "text without a language", None, "s")])
    assert [r.lang_pred for r in language_id.identify(none, language_id.learn(none)).collect()] == ["und"]
    assert language_id.identify(docs(spark, []), language_id.learn(docs(spark, []))).collect() == []


def test_pipeline_takes_the_language_on(spark):
    from auditloom.llm import language_id

    rng = random.Random(8)
    words = {"en": ["the", "house", "is", "green", "and", "old"], "de": ["das", "haus", "ist", "grün", "und", "alt"]}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(15)), k, "s") for i in range(200) for k in [("en", "de")[i % 2]]]
    rows += [(900, "the house is old and green", None, "s"), (901, "das haus ist alt und grün", "en", "s"), (902, None, "en", "s"), (903, "12 - 34", "en", "s")]
    d = docs(spark, rows)
    kept = {r.doc_id: r.lang for r in language_id.keep_identified(d, language_id.learn(d)).collect()}
    assert kept[900] == "en" and kept[901] == "de" and not {902, 903} & kept.keys() and len(kept) == 202


def test_links_of_ids_with_several_texts(spark):
    from auditloom.llm import ngram_jaccard

    base = [f"w{i}" for i in range(40)]
    near = lambda k: " ".join([*base[:-1], f"x{k}"])
    other = " ".join(f"o{i}" for i in range(30))
    rows = [(1, near(1), "en", "s"), (1, other, "en", "s"), (2, near(2), "en", "s"), (3, other + " more", "en", "s"), (4, near(4), "en", "s"), (5, "alone here", "en", "s"), (1, near(1), "en", "s")]
    got = ngram_jaccard.jaccard_components(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.links) for r in got) == [(1, 26, 1, 1), (1, 36, 1, 2), (1, 36, 1, 2), (2, 36, 1, 2), (3, 27, 1, 1), (4, 36, 1, 2), (5, 1, 5, 0)]
    assert ngram_jaccard.jaccard_components(docs(spark, [])).collect() == []


def test_names_with_capitals_inside(spark):
    from auditloom.llm import pii_surrogates

    texts = {1: "Mr. O'Neil met Mrs. McDonald.", 2: "Dr. DeVries and Mr. O'Neil's house", 3: "Ms. O'NEIL saw Mr. Smith-Jones and Mr. Smith’s son", 4: "Anna O'Neil"}
    out = {r.doc_id: r.text for r in pii_surrogates.replace(docs(spark, [(i, t, "en", "s") for i, t in texts.items()]), "key").collect()}
    for i, t in out.items():
        assert not any(x in t for x in ("Neil", "NEIL", "Donald", "Vries", "Smith", "Jones")), t
        assert len(t.split()) == len(texts[i].split())
    family = out[1].split()[1]
    assert family in out[2] and f"{family}'s house" in out[2] and family.upper() in out[3] and out[4].endswith(family)
    assert "’s son" in out[3]


def test_mix_gives_its_columns_way(spark):
    """Columns of the mix's own names are replaced, others stay; an empty table stays empty."""
    from auditloom.llm import pfair_mix

    rows = [(i, f"t{i}", "s" if i % 3 else None, -1, "x", -2, True) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, slot long, place string, release long, exact boolean")
    got = pfair_mix.mix(d).collect()
    assert sorted(r.doc_id for r in got) == list(range(40)) and len({(r.slot, r.place) for r in got}) == 40
    assert min(r.slot for r in got) == 0 and all(r.release >= 0 for r in got) and {r.text for r in got} == {f"t{i}" for i in range(40)}
    assert pfair_mix.mix(d.where("false")).collect() == []


def test_toxicity_of_empty_and_repeated(spark):
    from auditloom.llm import toxicity

    y = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    d = docs(spark, [(1, "bad words here", "en", "s"), (2, "good words here", "en", "s"), (2, "good words here", "en", "s")])
    m = toxicity.learn(d, y, fold=(4, 9))
    assert len(toxicity.score(d, m).collect()) == 3 and toxicity.score(d.where("false"), m).collect() == []
    assert toxicity.learn(d.where("false"), y).toxic == b""
