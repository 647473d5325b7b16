"""Surrogates, WARC derivatives, packing and the pipeline."""

import re
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from crossgrain.llm import packing, surrogates, warc

ROWS = "doc_id long, text string"


# ---- surrogates ----------------------------------------------------------------------------------

TEXTS = [
    "Write to Ann.Lee7@Mail2.example.com or ann.lee7@mail2.example.com, call +1 (743) 555-3824 or 743-555-3824.",
    "Card 4785380592391139 and 4785-3805-9239-1139, from 152.143.123.131, ssn 123-45-6789.",
    "Mrs. Anna Keller met Frau Keller and Mr Tom Keller; г-н Иван Петров и г-жа Анна Петрова.",
    "Nothing here: 12345, 1.2.3, a@b, version 1.2.3.4.5, 99999999999999999999.",
    "",
    None,
    "ann.lee7@mail2.example.com",
]


def surrogate_texts(spark, rows, **options):
    return {r.doc_id: r for r in surrogates.pseudonymized(spark.createDataFrame(rows, ROWS), **{"key": "k", **options}).collect()}


def test_surrogates_keep_type_format_and_identity(spark):
    got = surrogate_texts(spark, list(enumerate(TEXTS)), counts_col="n")
    assert [got[i].n for i in range(7)] == [4, 4, 5, 0, 0, 0, 1]
    assert [got[i].text for i in (3, 4, 5)] == TEXTS[3:6]
    a, b = re.findall(r"[\w.]+@[\w.]+\w", got[0].text)
    assert a.lower() == b == got[6].text != TEXTS[6] and b.endswith(".com") and re.fullmatch(r"[a-z]{3}\.[a-z]{3}\d@[a-z]{4}\d\.[a-z]{7}\.com", b)
    assert a[0].isupper() and a[4].isupper()
    long, short = re.search(r"call (\+1 \(\d{3}\) \d{3}-\d{4}) or (\d{3}-\d{3}-\d{4})\.", got[0].text).groups()
    assert re.sub(r"\D", "", long)[1:] == re.sub(r"\D", "", short) != "7435553824"
    cards = re.search(r"Card (4\d{15}) and (4\d{3}-\d{4}-\d{4}-\d{4}), from (\d{3}\.\d{3}\.\d{3}\.\d{3}), ssn (\d{3}-\d{2}-\d{4})", got[1].text).groups()
    assert cards[0] == cards[1].replace("-", "") != "4785380592391139"
    assert sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(cards[0])) % 10 == 0
    assert all(1 <= int(x) <= 255 for x in cards[2].split(".")) and cards[3] != "123-45-6789"
    m = re.fullmatch(r"Mrs\. (\w+) (\w+) met Frau (\w+) and Mr (\w+) (\w+); г-н (\w+) (\w+) и г-жа (\w+) (\w+)\.", got[2].text).groups()
    assert m[1] == m[2] and m[0][0].isupper() and "Keller" not in m and re.fullmatch("[А-Яа-я]+", m[5] + m[8])
    assert any(m[0].lower().endswith(e) for e in surrogates.ENDINGS["latin"]["f"]) and any(m[3].lower().endswith(e) for e in surrogates.ENDINGS["latin"]["m"])


def test_surrogates_depend_on_the_key_and_keep_columns(spark):
    rows = spark.createDataFrame([(1, TEXTS[0], "a", 5), (1, TEXTS[0], "a", 5), (2, "x", None, 6)], "doc_id long, text string, digest string, row int")
    one, two = (surrogates.pseudonymized(rows, key=k) for k in "ab")
    assert one.columns == rows.columns
    a, b = (sorted(r.text for r in x.collect()) for x in (one, two))
    assert len(a) == 3 and a[0] == a[1] and a != b and a == sorted(r.text for r in surrogates.pseudonymized(rows, key="a").collect())
    assert sorted((r.digest or "", r.row) for r in one.collect()) == [("", 6), ("a", 5), ("a", 5)]
    assert surrogates.pseudonymized(rows.where("false"), key="a").count() == 0


def test_distinct_entities_get_distinct_surrogates(spark):
    # two-digit octets leave few surrogates, so draws collide
    values = [f"{a}.{b}.1.1" for a in range(10, 40) for b in range(1, 9)] + [f"5.5.{i}.{j}" for i in range(1, 10) for j in range(1, 10)]
    entities = spark.createDataFrame([("ip", "", v) for v in values], "kind string, gender string, entity string")
    got = surrogates.surrogates(entities, key="k").collect()
    assert {r.entity for r in got} == set(values) and len({r.surrogate for r in got}) == len(values)
    assert not {r.surrogate for r in got} & set(values)


FORMS = [
    "Call +44 20 7946 0958, 020 7946 0958 or +33 1 23 45 67 89 / 01 23 45 67 89; +49 30 1234567 and (743) 555-3824.",
    "IBAN GB29 NWBK 6016 1331 9268 19 is GB29NWBK60161331926819, but GB30 NWBK 6016 1331 9268 19 is none. Amex 3782 822463 10005.",
    "From 2001:db8:0:0:8:800:200c:417a, 2001:db8::1 or fe80::1a2; at 12:30:45 a::b stays, std::vector too.",
    "Mr John Miller came. John Miller left with Dr Miller and Prof. Anna Stone; Mrs Anna Stone and Mr Miller stayed. Johnson Millers too.",
    "John Miller is said without a title here.",
    "x.y+z@a.b.c.d.e.f.g.h.i.j.k.example.org, " + "l" * 70 + "@example.org, a@example.org, b@EXAMPLE.org.",
]


def test_international_forms_and_coreference(spark):
    got = surrogate_texts(spark, list(enumerate(FORMS)), counts_col="n")
    assert [got[i].n for i in range(6)] == [5, 3, 3, 6, 0, 4]
    own = re.search(r"\+33 (\d[\d ]+\d) / 0(\d[\d ]+\d);", got[0].text)
    assert own[1] == own[2] != "1 23 45 67 89" and "+49 " in got[0].text and "1234567" not in got[0].text
    assert "+44 " in got[0].text and "020 7946 0958" in got[0].text  # the latter's form is not told from a number
    ibans = re.match(r"IBAN (GB\d\d [A-Z]{4}(?: \d{4}){3} \d\d) is (GB\d\d[A-Z]{4}\d{14}), but GB30 NWBK 6016 1331 9268 19 is none\. Amex 3\d{3} \d{6} \d{5}\.", got[1].text).groups()
    plain = ibans[0].replace(" ", "")
    assert plain == ibans[1] != "GB29NWBK60161331926819" and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    ip = re.fullmatch(r"From ([0-9a-f:]+), ([0-9a-f]{4}:[0-9a-f]{3}::[0-9a-f]) or ([0-9a-f]{4}::[0-9a-f]{3}); at 12:30:45 a::b stays, std::vector too\.", got[2].text).groups()
    assert [len(x) for x in ip[0].split(":")] == [4, 3, 1, 1, 1, 3, 4, 4] and ip[2] != "fe80::1a2"
    m = re.fullmatch(r"Mr (\w+) (\w+) came\. (\w+) (\w+) left with Dr (\w+) and Prof\. (\w+) (\w+); Mrs (\w+) (\w+) and Mr (\w+) stayed\. Johnson Millers too\.", got[3].text).groups()
    assert m[0] == m[2] != "John" and m[1] == m[3] == m[4] == m[9] != "Miller" and m[5:7] == m[7:9] and got[4].text == FORMS[4]
    mails = re.findall(r"[^ ,]+@[^ ,]+\w", got[5].text)
    domains = [x.split("@")[1].lower() for x in mails]
    assert domains[1] == domains[2] == domains[3] != domains[0] and not any("example" in d for d in domains) and [len(x) for x in mails] == [len(x) for x in re.findall(r"[^ ,]+@[^ ,]+\w", FORMS[5])]


def plain_surrogates(rows, key):
    """Detection, draws and rounds over again, in plain Python, for telephones of 3-3-4 digits, addresses and security numbers."""
    import hashlib

    seen = re.compile(r"(?P<mail>[A-Za-z0-9._%+-]+@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,24})|(?P<ssn>\d{3}-\d{2}-\d{4})|(?P<ip>\d+\.\d+\.\d+\.\d+)|(?P<phone>\d{3}-\d{3}-\d{4})")
    entities = {}
    for text in rows:
        for m in seen.finditer(text):
            if m["mail"]:
                entities["mailbox", m[0].lower()] = entities["domain", m[0].lower().split("@")[1]] = None
            else:
                entities[m.lastgroup, m[0] if m["ip"] else re.sub(r"\D", "", m[0])] = None

    def draw(kind, entity, turn):
        digest = "".join(hashlib.sha256("\x1f".join((key, kind, entity, str(turn), part)).encode()).hexdigest() for part in "abcd")
        d = [int(digest[4 * i : 4 * i + 4], 16) for i in range(64)]
        if kind in ("mailbox", "domain"):
            head, sign, tail = entity.partition("@") if kind == "mailbox" else entity.rpartition(".")
            return "".join(str((d[i % 64] + i) % 10) if c.isdigit() else chr(97 + (d[i % 64] + i) % 26) if c.isalpha() else c for i, c in enumerate(head)) + sign + tail
        if kind == "ip":
            top = lambda i: 223 if i == 0 else 255
            return ".".join(str(d[i] % 9 + 1 if len(o) == 1 else d[i] % 90 + 10 if len(o) == 2 else d[i] % (top(i) - 99) + 100) for i, o in enumerate(entity.split(".")))
        return "".join((c if c == "0" else str(d[i] % 9 + 1)) if i == 0 else str(d[i % 64] % 10) for i, c in enumerate(entity))

    turn, taken = 0, {}
    while left := sorted(k for k, v in entities.items() if v is None):
        now = {}
        for kind, entity in left:
            new = draw(kind, entity, turn)
            if (kind, new) not in entities and (kind, new) not in taken:
                now.setdefault((kind, new), entity)
        for (kind, new), entity in now.items():
            entities[kind, entity] = taken[kind, new] = new
        turn += 1

    def put(m):
        if m["mail"]:
            return entities["mailbox", m[0]].split("@")[0] + "@" + entities["domain", m[0].split("@")[1]]
        if m["ip"]:
            return entities["ip", m[0]]
        digits = iter(entities[m.lastgroup, re.sub(r"\D", "", m[0])])
        return "".join(next(digits) if c.isdigit() else c for c in m[0])

    return [seen.sub(put, text) for text in rows], turn


def test_surrogates_are_the_keyed_draws(spark):
    rng = np.random.default_rng(5)
    rows = [f"to {c}{d}@{'ab'[k % 2]}x{k % 3}.org or {rng.integers(1, 10)}.{rng.integers(1, 10)}.1.{k % 7}, {rng.integers(100, 999)}-{rng.integers(10, 99)}-{rng.integers(1000, 9999)} and {rng.integers(100, 999)}-555-{k + 1000}." for k in range(300) for c, d in [("abcdefghij"[k % 10], k % 4)]]
    want, rounds = plain_surrogates(rows, "a key")
    got = surrogate_texts(spark, list(enumerate(rows)), key="a key")
    assert rounds > 1 and [got[i].text for i in range(300)] == want


def test_names_for_which_no_room_is_left_are_an_error(spark):
    entities = spark.createDataFrame([("ssn", "", str(v)) for v in range(1, 10)], "kind string, gender string, entity string")
    with pytest.raises(ValueError, match="ssn"):
        surrogates.surrogates(entities, key="k", most_rounds=3)


#: Forms of address and names in four languages; every one of a language stands before every name of it.
PEOPLE = {
    "en": (
        ("Mr", "Mr.", "Mrs", "Ms.", "Miss", "Dr", "Dr.", "Prof. Dr.", "Professor", "MR", "MRS."),
        ("Smith", "McDonald", "O'Brien", "John Smith", "J. Smith", "J.R. Smith", "John F. Kennedy", "JOHN SMITH", "Mary-Ann Lee", "de Vries", "Ludwig van Beethoven", "José Ruiz", "J Smith"),
    ),
    "de": (
        ("Frau", "Herr", "Herrn", "Frau Dr.", "Herr Prof. Dr.", "Herr Dr. med.", "FRAU", "Frau Prof.", "Herr Dipl.-Ing."),
        ("Müller", "Erika Mustermann", "Müller-Lüdenscheidt", "Hans-Peter Groß", "von Weizsäcker", "Otto von der Heide", "K. Schäfer", "ERIKA MÜLLER", "Ju\u0308rgen Ku\u0308hn", "Anna Lena Weiß"),
    ),
    "fr": (
        ("Monsieur", "Madame", "Mme", "Mlle", "Mademoiselle", "Mme.", "Dr", "Madame la Professeur"),
        ("Durand", "Marie DUPONT", "Jean-Pierre Lefèvre", "d'Artagnan", "de la Tour", "Anne L'Hôte", "É. Zola", "Rene\u0301 Descartes", "Marie Anne Petit"),
    ),
    "es": (
        ("Señor", "Señora", "Señorita", "Sr.", "Sra.", "Srta.", "Sr. Dr.", "SEÑORA", "Don"),
        ("García", "García Lorca Pérez", "José Ruiz", "Jose\u0301 Ruiz", "María de los Ángeles", "de la Cruz", "P. Almodóvar", "ANA PÉREZ", "Núñez y Vaca"),
    ),
}
#: Whole frames, with what follows a name.
FRAMES = ("then {} came late.", "({})", "{}, and more")


def forms():
    return [(f"{t} {n}", n) for titles, names in PEOPLE.values() for t in titles for n in names]


def said_words(name):
    """The words of a name that are somebody's own."""
    return [w for w in regex.findall(r"\p{L}+", unicodedata.normalize("NFC", name)) if len(w) > 1 and w not in surrogates.PARTICLES]


def test_forms_of_address_before_names(spark):
    rows = [(i, FRAMES[i % 3].format(form)) for i, (form, _) in enumerate(forms())]
    got = surrogate_texts(spark, rows, counts_col="n")
    missed = []
    for i, (form, name) in enumerate(forms()):
        head, tail = FRAMES[i % 3].split("{}")
        text = got[i].text
        assert text.startswith(head + form.split(" ")[0]) and text.endswith(tail), (form, text)
        left = regex.findall(r"\p{L}+", unicodedata.normalize("NFC", text))
        if set(said_words(name)) & set(left):
            missed.append(form)
            continue
        # word for word, with the same signs between and the same capitals, for words without inner ones
        title = form[: len(form) - len(name)]
        assert text.startswith(head + title), (form, text)
        new = text[len(head) + len(title) : len(text) - len(tail)]
        plain = unicodedata.normalize("NFC", name)
        assert regex.findall(r"[^\p{L}]+", new) == regex.findall(r"[^\p{L}]+", plain), (form, text)
        shape = lambda w: (w[0].isupper(), len(w) > 1 and w.isupper(), len(w) == 1)
        assert [shape(w) for w in regex.findall(r"\p{L}+", new)] == [shape(w) for w in regex.findall(r"\p{L}+", plain)], (form, text)
    assert len(forms()) >= 200 and len(missed) <= 0.05 * len(forms()), missed
    # what is missed: forms of address that are not in the list
    assert {m.split(" ")[0] for m in missed} == {"Don"}


def test_names_that_meet_again(spark):
    texts = [
        "Mr J. R. Smith-Jones and Mrs Smith met. J. R. Smith-Jones left, JONES too.",
        "Herr José Ruiz, Herr Jose\u0301 Ruiz and Frau José Kern.",
        "Mr Smith's dog, Mr Smith9, Mr Smith. The end. Mr and Mrs; Dr. Dr. Mr",
        "Mr O'Brien of D'Arcy, Mme L'Hôte d'Arc, Mr de la, Mr von, Mr A.",
        "MR JOHN SMITH WENT HOME and Mr Smith, Dr. Anna Smith",
    ]
    got = surrogate_texts(spark, list(enumerate(texts)), counts_col="n")
    assert [got[i].n for i in range(5)] == [3, 3, 2, 2, 3]
    a = re.fullmatch(r"Mr (\w)\. (\w)\. (\w+)-(\w+) and Mrs (\w+) met\. (\w)\. (\w)\. (\w+)-(\w+) left, JONES too\.", got[0].text).groups()
    assert a[:4] == a[5:] and a[2] == a[4] != "Smith" and a[0] != a[1] and not {"J", "R"} & {a[0]} and a[1] != "R"
    b = re.fullmatch(r"Herr (\w+) (\w+), Herr (\w+) (\w+) and Frau (\w+) (\w+)\.", got[1].text).groups()
    assert b[0] == b[2] == b[4] and b[1] == b[3] and not {"José", "Ruiz", "Kern"} & set(b)
    c = re.fullmatch(r"Mr (\w+)'s dog, Mr Smith9, Mr (\w+)\. The end\. Mr and Mrs; Dr\. Dr\. Mr", got[2].text).groups()
    assert c[0] == c[1] == a[2]
    d = re.fullmatch(r"Mr O'(\w+) of D'Arcy, Mme L'(\w+) d'(\w+), Mr de la, Mr von, Mr A\.", got[3].text).groups()
    assert not {"Brien", "Hôte", "Arc"} & set(d)
    e = re.fullmatch(r"MR (\w+) (\w+) WENT HOME and Mr (\w+), Dr\. (\w+) (\w+)", got[4].text).groups()
    assert e[1] == a[2].upper() and e[2] == e[4] == a[2] and e[0].isupper()


def test_addresses_of_other_letters(spark):
    texts = ["jörg.müller@example.de, JO\u0308RG.MÜLLER@Example.de; иван.петров7@пример.рф and a@bücher.example."]
    got = surrogate_texts(spark, list(enumerate(texts)), counts_col="n")[0]
    assert got.n == 4
    a, b, c, d = regex.match(r"(\S+), (\S+); (\S+) and (\S+)\.$", got.text).groups()
    assert a == b.lower() and regex.fullmatch(r"\p{Latin}{4}\.\p{Latin}{6}@[a-z]{7}\.de", a) and not {"jörg", "müller"} & set(re.split("[.@]", a))
    assert regex.fullmatch(r"\p{Cyrillic}{4}\.\p{Cyrillic}{6}\d@\p{Cyrillic}{6}\.рф", c) and "иван" not in c
    assert regex.fullmatch(r"[a-z]@\p{Latin}{6}\.example", d) and "bücher" not in d


def test_formats_without_room_grow(spark):
    """All addresses of the form h:h::h, and all telephones of one short form."""
    hexes = "123456789abcdef"
    ip6 = [f"{a}:{b}::{c}" for a in hexes for b in hexes for c in hexes]
    phones = [f"{v}" for v in range(100, 1000)]
    entities = spark.createDataFrame([("ip6", "", v) for v in ip6] + [("phone", "", v) for v in phones], "kind string, gender string, entity string")
    got = surrogates.surrogates(entities, key="k").collect()
    assert {(r.kind, r.entity) for r in got} == {("ip6", v) for v in ip6} | {("phone", v) for v in phones}
    assert len({(r.kind, r.surrogate) for r in got}) == len(ip6) + len(phones) and not {r.surrogate for r in got} & {*ip6, *phones}
    shown = spark.createDataFrame([("+35 (1) 23", "123", "98765")], "word string, entity string, surrogate string")
    assert shown.select(surrogates.rendered(F.lit("phone"), F.col("word"), F.col("entity"), F.col("surrogate")).alias("x")).first().x == "+35 (9) 8765"


def test_surrogate_query_leaves_no_entity_and_clean_texts_alone(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    seen = regex.compile("|".join(f"(?:{p})" for p in (surrogates.EMAIL, surrogates.CARD, surrogates.IPV4, surrogates.PHONE)))
    real = {m[0] for t in docs.values() for m in seen.finditer(t or "")}
    got = surrogates.op4_surrogates(spark, sf).collect()
    assert len(got) == len(docs) and real
    for r in got:
        found = [m[0] for m in seen.finditer(docs[r.doc_id] or "")]
        assert r.n_entities == len(found)
        assert (r.text == docs[r.doc_id]) == (not found)
        assert not real & {m[0] for m in seen.finditer(r.text or "")}
        assert len(r.text or "") == len(docs[r.doc_id] or "")


# ---- WARC ----------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html lang="fr"><head><meta charset="utf-8"><title>A &amp;
 b</title><style>p{x:1}</style><script>var t="</p>";</script></head><body><!-- no --><h1>Un</h1><p>deux <b>trois</b>&nbsp;&eacute;<br>quatre<ul><li><a href="/x?a=1&amp;b=2">cinq</a></li></ul></body></html>"""


def test_plain_text_and_metadata():
    assert warc.plain_text(PAGE) == "Un\ndeux trois é\nquatre\ncinq"
    assert warc.about(PAGE) == [("title", "A & b"), ("lang", "fr"), ("charset", "utf-8"), ("outlink", "/x?a=1&b=2")]
    assert warc.plain_text("") == warc.plain_text("<script>x") == ""


def test_a_head_may_lack_its_end_tag():
    assert warc.plain_text("<html><head><title>t</title><body><p>All the text</p>") == "All the text"
    assert warc.plain_text("<head><meta charset=utf-8><!-- x --><title>t</title>\n<style>p{}</style><script>'<p>'</script><p>One<div>two</div>") == "One\ntwo"
    assert warc.plain_text("<head><title>t</title>Bare text<p>and more") == "Bare text\nand more"
    assert warc.plain_text("<head><title>t<meta name=a><body>Text") == warc.plain_text("<head><title>t</head>Text") == "Text"
    assert warc.plain_text("<head><title>the <b> tag</title></head><header>Top</header><svg><title>icon</title></svg>") == "Top\nicon"
    assert warc.plain_text("<head>" + "<meta>" * 50_000 + "<p>x") == "x"


def test_stray_signs_quotes_and_what_comments_say():
    assert warc.plain_text("<p>a <b and c</p><p>d</p>") == "a <b and c\nd" and warc.plain_text("1 < 2 > 0") == "1 < 2 > 0"
    assert warc.plain_text("<a title='x > y'>link</a> <img alt=\"it's\">z") == "link z" and warc.plain_text("<i don't>x") == "x"
    assert warc.about("<!-- <a href=no> --><script>'<a href=no>'</script><a href=yes>") == [("outlink", "yes")]


def test_malformed_pages_take_time_in_proportion():
    import time

    for piece in ("<a ", "<html ", "<title>", "<a href='", '<a href="x" ', "<html lang", "</a <", "<a\t<!-", "<title", "<a b=\"", "<script ", "<!"):
        page = piece * (300_000 // len(piece))
        start = time.process_time()
        warc.about(page), warc.plain_text(page)
        assert time.process_time() - start < 2, piece
    page = "<a " * 1_700_000
    start = time.process_time()
    warc.about(page)
    assert time.process_time() - start < 3
    assert warc.about("<title>a <b>x</b></title><title>second</title>") == [("title", "a <b>x</b>")] and warc.about("<title>never closed<a href=1>") == [("outlink", "1")]
    assert warc.about("<html class=x><html lang=de><A HREF = 'u v'>") == [("lang", "de"), ("outlink", "u v")]


def test_a_plain_file_of_many_splits(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    blocks = [http + f"<p>{k} WARC/1.0\r\nWARC/1.1 ".encode() + b"x WARC/1. " * (k % 7 * 150) for k in range(400)]
    record = lambda k, b: f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{k}>\r\nContent-Length: {len(b)}\r\n\r\n".encode() + b + b"\r\n\r\n"
    for name, part in (("a.warc", range(0, 300)), ("b.warc", range(300, 400))):
        (tmp_path / name).write_bytes(b"".join(record(k, blocks[k]) for k in part))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        got = {r.record_id: bytes(r.block) for r in warc.read_warc(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert got == {f"<urn:uuid:{k}>": b for k, b in enumerate(blocks)}


def sha1(data):
    import base64
    import hashlib

    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def parsed_text(page):
    """By the standard library's parser."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.off, self.head = [], [], False

        def handle_starttag(self, tag, attrs):
            if tag == "head":
                self.head = True
            elif tag in warc.HIDDEN:
                self.off.append(tag)
            self.out.append("\n" if tag in warc.BLOCKS and not self.head else "")

        def handle_endtag(self, tag):
            if tag == "head":
                self.head = False
            elif tag in self.off:
                self.off.remove(tag)
            self.out.append("\n" if tag in warc.BLOCKS and not self.head else "")

        def handle_data(self, data):
            if not self.off and not self.head:
                self.out.append(data.replace("\n", " "))

    reader = Reader()
    reader.feed(page)
    reader.close()
    lines = [" ".join(x.split()) for x in "".join(reader.out).split("\n")]
    return "\n".join(x for x in lines if x)


def test_derivatives_are_linked_and_digested(spark):
    pages = spark.createDataFrame([(1, "http://a/", PAGE, "q"), (2, None, None, "q"), (1, "http://a/", PAGE, "q"), (1, "http://a/", "other", "q")], "page_id long, url string, html string, record_id string")
    source = {r.record_id: r for r in warc.responses(pages).collect()}
    got = warc.derivatives(warc.responses(pages)).collect()
    assert len(got) == 8 and len(source) == 3 and len({r.record_id for r in got}) == 6
    for r in got:
        s = source[r.refers_to]
        payload = bytes(s.block).partition(b"\r\n\r\n")[2]
        own = dict((h.name, h.value) for h in r.headers)
        assert r.target_uri == s.target_uri == own["WARC-Refers-To-Target-URI"] and own["WARC-Source-Payload-Digest"] == s.payload_digest == sha1(payload) and s.block_digest == sha1(bytes(s.block))
        assert r.block_digest == r.payload_digest == sha1(bytes(r.block)) and r.concurrent_to in {x.record_id for x in got if x.warc_type != r.warc_type and x.refers_to == r.refers_to}
        if r.warc_type == "conversion":
            assert own["source-content-type"] == "text/html; charset=utf-8" and bytes(r.block).decode() == warc.plain_text(payload.decode())
        else:
            assert f"source-payload-digest: {s.payload_digest}\r\n" in bytes(r.block).decode()
    assert warc.derivatives(warc.responses(pages.where("false"))).count() == 0


def test_files_round_trip(spark, sf, tmp_path):
    records = warc.responses(spark.read.parquet(f"{sf}/pages.parquet"))
    every = records.union(warc.derivatives(records))
    warc.write_warc(every, str(tmp_path / "w"))
    cols = [c for c in every.columns if c != "key"]
    back = warc.read_warc(spark, str(tmp_path / "w"))
    key = lambda r: r.record_id
    assert sorted(back.select(cols).collect(), key=key) == sorted(every.select(cols).collect(), key=key)
    again = warc.derivatives(back).select(cols).collect()
    assert sorted(again, key=key) == sorted((r for r in every.select(cols).collect() if r.warc_type != "response"), key=key)


def test_files_of_others(spark, tmp_path):
    """Latin-1, blocks that hold version lines and blank lines, long blocks, several gzip members."""
    import gzip

    def record(k, block, kind="response"):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{k}>\r\nWARC-Target-URI: http://x/{k}\r\nContent-Length: {len(block)}\r\nX-Own: a: b\r\n\r\n".encode() + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\n\r\n"
    blocks = [http + "<p>é à</p>".encode("latin-1"), http + b"<p>WARC/1.0\r\n\r\nWARC/1.1 x</p>", b"", http.replace(b"; charset=iso-8859-1", b"") + b"<p>\xff\xfe</p>", http + b"<p>" + b"long " * 400_000 + b"</p>"]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc.gz").write_bytes(b"".join(gzip.compress(record(k, b)) for k, b in enumerate(blocks)))
    (tmp_path / "w" / "b.warc").write_bytes(record(9, b"k: v\r\n", "warcinfo"))
    got = {r.record_id: r for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    assert [bytes(got[f"<urn:uuid:{k}>"].block) for k in range(5)] == blocks and got["<urn:uuid:9>"].warc_type == "warcinfo"
    assert [(h.name, h.value) for h in got["<urn:uuid:0>"].headers] == [("X-Own", "a: b")]
    texts = {r.refers_to: bytes(r.block).decode() for r in warc.derivatives(warc.read_warc(spark, str(tmp_path / "w"))).where("warc_type = 'conversion'").collect()}
    assert [texts[f"<urn:uuid:{k}>"] for k in range(4)] == ["é à", "WARC/1.0 WARC/1.1 x", "", "��"]
    assert len(texts["<urn:uuid:4>"]) == 5 * 400_000 - 1


def test_warc_query_matches_the_library_parser(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = warc.op5_warc(spark, sf).collect()
    assert sorted((r.page_id, r.warc_type) for r in got) == sorted((k, t) for k in pages for t in ("metadata", "conversion"))
    for r in got:
        page = pages[r.page_id]
        assert r.target_uri == page.url and r.block_digest == sha1(r.block.encode()) and dict((h.name, h.value) for h in r.headers)["WARC-Source-Payload-Digest"] == sha1((page.html or "").encode())
        if r.warc_type == "conversion":
            assert r.block == parsed_text(page.html or "")


# ---- packing -------------------------------------------------------------------------------------


def sequences(pieces, size):
    """Checks that sequences are gapless; the padding's share."""
    by = defaultdict(list)
    for p in pieces:
        by[p.sequence_id].append((p.offset, p.length))
    used = []
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= size
        used.append(at)
    assert sorted(by) == list(range(len(by)))
    return sum(size - u for u in used if u & (u - 1)) / max(1, sum(used))


def check_pieces(pieces, ids, size):
    own = defaultdict(list)
    for p in pieces:
        own[p.doc_id].append(p)
    assert sorted(own) == sorted(ids)
    for doc, want in ids.items():
        at = 0
        for p in sorted(own[doc], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(want) and list(p.ids) == want[at : at + p.length]
            at += p.length
        assert at == len(want)


@pytest.mark.parametrize("name", ["mixed", "alike", "small"])
def test_plans_place_every_tail(name):
    rng = np.random.default_rng(3)
    lengths = {"mixed": rng.integers(1, 2048, 5000), "alike": np.full(4000, 1400), "small": np.array([100] * 33 + [7])}[name]
    histogram = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True))}
    plan = packing.plan(histogram, 2048)
    fill = defaultdict(list)
    for length, n in histogram.items():
        for rank in range(n):
            at = 0
            for start, size, sequence, offset in sorted(plan.pieces(length, rank)):
                assert start == at
                at += size
                fill[sequence].append((offset, size))
            assert at == length
    assert sorted(fill) == list(range(plan.sequences))
    for places in fill.values():
        at = 0
        for offset, size in sorted(places):
            assert offset == at
            at += size
        assert at <= 2048
    if name != "small":
        assert 1 - lengths.sum() / (2048 * plan.sequences) < 0.004


def test_packing_round_trip(spark, sf):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer())
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(5)
    ids = {r.doc_id: [*whole.encode(r.text or "", add_special_tokens=False).ids, packing.END] for r in docs.collect()}
    pieces = packing.pack(docs).collect()
    check_pieces(pieces, ids, packing.SIZE)
    assert sequences(pieces, packing.SIZE) < 0.02
    sums = {(r.doc_id, r.start): r.ids_crc32 for r in packing.op10_packing(spark, sf).collect()}
    for doc, own in ids.items():
        for start, crc in ((s, c) for (d, s), c in sums.items() if d == doc):
            assert crc in {zlib.crc32(np.array(own[start:end], "<u4").tobytes()) for end in range(start + 1, len(own) + 1)}


def test_packing_edge_rows(spark):
    rows = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "<|endoftext|> é\U0001f600" * 40, 3), (3, "again", 4), (4, "a" * 5000, 5)], "doc_id long, text string, ids int")
    pieces = packing.pack(rows, size=64).collect()
    sequences(pieces, 64)
    assert sorted((p.doc_id, list(p.ids)) for p in pieces if p.doc_id < 3) == [(1, [1]), (2, [1])]
    assert sum(p.length for p in pieces if p.doc_id == 4) == next(p.doc_tokens for p in pieces if p.doc_id == 4)
    assert packing.pack(rows.where("false")).count() == 0


def test_encoder_gives_the_ids_of_tokenizers():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer())
    encode = packing.encoder(packing.default_tokenizer())
    spaces = [c * n for c in (" ", "\n") for n in (packing.LONG_SPACE - 1, packing.LONG_SPACE, 1_000_000)]
    for text in ["a <|endoftext|> b", "<|endoftext|><|endoftext|>x", " <|endoftext|", "", *spaces, *(f"a{x}b" for x in spaces)]:
        assert encode(text) == whole.encode(text, add_special_tokens=False).ids


# ---- the pipeline --------------------------------------------------------------------------------


def test_pipeline_stages_decide_as_brute_force(spark, sf):
    """Near-duplicates by five words and 0.8, as the stage's rule is; surrogates of one key, or two runs would differ."""
    spark.conf.set("spark.crossgrain.surrogate.key", "one key")
    from tests.llm.test_dedup import plain_groups
    from tests.llm.test_text import plain_contamination

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(100001, "12 34", "en", "s", 5), (100002, None, None, "s", 0), (100003, "", "en", "s", 0)], docs.schema)
    now = docs.union(extra)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language_id"](spark, now, sf)
    assert kept.columns == docs.columns and sorted(kept.collect()) == sorted(docs.collect())
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    alone = stages["near_duplicates"](spark, kept, sf)
    assert sorted(r.doc_id for r in alone.collect()) == sorted(set(plain_groups(rows).values()))
    clean = stages["decontamination"](spark, alone, sf)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in alone.collect()}
    assert sorted(r.doc_id for r in clean.collect()) == sorted(x[0] for x in plain_contamination(sorted(texts.items()), items) if not x[-1])
    masked = stages["personal_data"](spark, clean, sf)
    assert masked.columns == docs.columns and masked.count() == clean.count()
    pieces = stages["packing"](spark, masked, sf).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in masked.collect()}
    done = corpus_pipeline.run(spark, sf)
    assert done.agg(F.sum("length")).first()[0] == sum(p.length for p in pieces)


CLASHES = "doc_id long, text string, lang string, source string, n_chars int, lang_pred string, first_id string, row string, place int, `a.b` string, mentions int, ids string"


def test_pipeline_stages_with_shared_ids_and_clashing_columns(spark, sf):
    """Ids that are shared or null, clashing and dotted names, repeated, empty, null and very long texts, and an empty table."""
    rest = ("x", "y", "r", 1, "dot", 2, "z")
    long = " ".join(f"wort{i % 977}" for i in range(200_000))
    rows = [(1, "the first of two texts with one id", "en", "s", 34, *rest), (1, "quite another one is this text of ours", "en", "s", 38, *rest), (None, "no id at all has this text here", None, "s", 31, *rest)]
    rows += [(None, "and none has this other text either", "en", None, 35, *rest), (2, long, "de", "s", len(long), *rest), (3, long, "de", "s", len(long), *rest), (4, None, None, "s", 0, *rest), (5, "", "en", "s", 0, *rest), (6, "x", "en", "s", 1, *rest), (6, "x", "en", "s", 1, *rest)]
    rows += [(7, "η γλώσσα αυτή δεν έχει διδαχθεί ποτέ και δεν μοιάζει με καμία άλλη γλώσσα του πίνακα", None, "s", 84, *rest)]
    docs = spark.createDataFrame(rows, CLASHES)
    kept = {"language_id": 8, "near_duplicates": 6, "decontamination": 6, "personal_data": 6}
    want = [r for r in rows if r[0] not in (4, 5, 7)]
    assert [kept["language_id"]] == [len(want)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.where("false"), sf).count() == 0
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == spark.createDataFrame([], CLASHES).columns and docs.count() == kept[name]
        if name == "language_id":
            assert all(r.lang for r in docs.collect())
        else:
            assert {(r.doc_id, r.text) for r in docs.collect()} == {(r[0], r[1]) for r in want if r[0] != 3}
        assert {r["a.b"] for r in docs.collect()} == {"dot"}
    pieces = corpus_pipeline.packed(spark, docs, sf).collect()
    assert sum(p.start == 0 for p in pieces) == 6
    assert corpus_pipeline.packed(spark, docs.where("false"), sf).count() == 0
