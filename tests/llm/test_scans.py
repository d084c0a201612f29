"""op2 and op7 against plain Python over whole small tables, and on odd rows."""

import hashlib
import math
import random
import re

import pytest

from fairground.llm import licenses, pii
from fairground.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ODD = [
    "mail a.b+c@d-e.co.uk, x@y z@w.q._r@s.t", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 010.0.0.1 999999999999999999999.1.1.1", "4465758382889437 4465 7583 8288 9437 4465-7583-8288-9438 1 2 3",
    "+1 (743) 555-3824, +12 +123456789012345678 ++49.30.1234567-", "😀 a@b.c 😀 +1 (743) 555-3824 é 4465758382889437", "", None, " ", "0" * 5000 + "@" + "a." * 3000 + "b", "1 " * 4000, "%" * 3000 + "@",
]


def luhn(digits: str) -> bool:
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(digits)))) % 10 == 0


def good(kind: str, m: str) -> bool:
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x or 0) <= 255 for x in (p.lstrip("0")[:9] for p in m.split(".")))
    return kind == "email" or kind == "card" and 13 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15


def plain_spans(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if good(k, m[0])] for k, p in PATTERNS.items()}


def check_pii(rows, found):
    assert len(rows) == len(found)
    for doc_id, text in rows.items():
        spans, r = plain_spans(text), found[doc_id]
        base = ",".join(f"{k}:{a}:{b}" for k, x in spans.items() for a, b in x)
        assert [r[f"n_{k}"] for k in PATTERNS] == [len(x) for x in spans.values()], (text or "")[:80]
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert r["spans"] == base or r["spans"].startswith(base)


def test_pii_on_a_whole_table(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check_pii(rows, {r.doc_id: r for r in QUERIES["op2_pii"](spark, SF).collect()})


def test_pii_on_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(ODD)], "doc_id long, text string, h string, email_m string")
    check_pii(dict(enumerate(ODD)), {r.doc_id: r for r in pii.digest(docs).collect()})
    assert pii.digest(docs.limit(0)).count() == 0
    assert pii.digest(docs.selectExpr("CAST(NULL AS long) AS doc_id", "text")).count() == len(ODD)
    clean = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    assert clean[0].sanitised == "mail [EMAIL], x@y [EMAIL][EMAIL]" and clean[6].sanitised is None and clean[5].sanitised == ""
    assert clean[4].sanitised == "😀 [EMAIL] 😀 [PHONE] é [CARD]" and clean[2].h == "x" and clean[2].email_m == "y"


def test_sensitive_terms(spark):
    """A name that stands near one address only is found wherever it occurs; common words are not."""
    filler = "the quick brown foxes jumped over many lazy dogs while seven others waited there".split()
    rows = [f"note {i}: {' '.join(filler[i % 5:])} Quorvex wrote from quorvex.k@mail.example.com again" for i in range(8)]
    rows += [f"{' '.join(filler[i % 7:])} case {i} without address" for i in range(400)] + ["then the quick brown foxes met Quorvex", None, ""]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    terms = {r.term for r in pii.sensitive_terms(docs).collect()}
    assert "Quorvex" in terms and not terms & set(filler)
    found = {r.doc_id: r for r in pii.digest(docs).collect()}
    at = rows[408].index("Quorvex")
    assert found[408].spans == f"term:{at}:{at + 7}" and found[20].n_term == 0
    assert "Quorvex" not in pii.sanitise(docs).where("doc_id = 408").first().sanitised


def test_sensitive_terms_of_hot_and_rare_values(spark):
    """A third of all texts, a small table, two texts of many, and a name far from its address."""
    plain = lambda n: [f"{['lazy', 'quick', 'brown'][i % 3]} dogs waited over there {i}" for i in range(n)]
    named = lambda n: [f"Quorvex over there {i} quorvex.k@mail.example.com" for i in range(n)]
    far = [f"quorvex.k@mail.example.com {'over there ' * 40} Quorvex {i}" for i in range(6)]
    for rows in (named(100) + plain(200), named(4) + plain(8), named(2) + plain(300), named(6) + far + plain(200)):
        docs = spark.createDataFrame(list(enumerate([*rows, "then Quorvex left"] if len(rows) == 300 else rows)), "doc_id long, text string")
        terms = {r.term for r in pii.sensitive_terms(docs).collect()}
        assert "Quorvex" in terms and not terms & {"over", "there", "dogs", "lazy"}


def test_sensitive_terms_far_from_their_value(spark):
    """Names that never stand near their address, before and after it, and one text with many values."""
    filler = "the lazy dogs waited over there while seven others slept "
    rows = [f"Quorvex {i} {filler * 12} quorvex.k@mail.example.com {filler * 12} Zimbrol" for i in range(6)]
    rows += [f"{filler} {i}" for i in range(200)] + ["then Quorvex met Zimbrol", " ".join(f"u{i}@mail.example.com" for i in range(50))]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {(r.term, r.entity, r.near, r.documents, r.removed) for r in pii.sensitive_terms(docs).collect()}
    assert found == {(t, "email:quorvex.k@mail.example.com", 6.0, 7.0, False) for t in ("Quorvex", "Zimbrol")}
    assert {(t, e, r) for t, e, _, _, r in found} == plain_terms(rows)
    assert pii.sanitise(docs).where("doc_id = 206").first().sanitised == "then [Q.] met [Z.]"


def plain_terms(rows):
    """The whole rule on one machine: texts with a term, texts with a value, both near one another."""
    texts = {t or "" for t in rows}
    near, holders, counts = {}, {}, {}
    for text in texts:
        bare = re.sub(PATTERNS["email"], " ", text)
        for term in set(re.findall(r"[^\W\d_]+", bare)):
            counts[term] = counts.get(term, 0) + 1
    for text in texts:
        for kind, pattern in PATTERNS.items():
            for m in re.finditer(pattern, text):
                if good(kind, m[0]):
                    key = f"{kind}:{m[0].lower() if kind in ('email', 'ip') else re.sub('[^0-9]', '', m[0])}"
                    holders.setdefault(key, set()).add(text)
    out = set()
    for key, held in holders.items():
        own = math.log2(len(texts) / len(held))
        for term, n in counts.items():
            both = sum(term in re.findall(r"[^\W\d_]+", re.sub(PATTERNS["email"], " ", t)) for t in held)
            if both and (left := math.log2((n + pii.DOUBT) / both)) <= pii.VAGUE_BITS * min(1, own) + 1e-12:
                removed = left <= pii.LEFT_BITS * min(1, own) + 1e-12
                if removed or n >= pii.VAGUE_TEXTS:
                    out.add((term, key, removed))
    return out


def test_sensitive_terms_against_plain_counts(spark):
    rng = random.Random(4)
    names = [f"Name{chr(65 + i)}" + "x" * (i * 9) for i in range(8)]
    rows = []
    for i in range(300):
        n = rng.randrange(8)
        who = f"{names[n]} at {names[n].lower()[:6]}@mail.example.com" if rng.random() < 0.4 else rng.choice(["", names[n] if rng.random() < 0.1 else ""])
        rows.append(f"{rng.choice(['old', 'new'])} note {who} of {rng.choice(['red', 'blue', 'green'])} {i}")
    rows += [None, "", rows[0], rows[0]]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {(r.term, r.entity, r.removed) for r in pii.sensitive_terms(docs).collect()}
    assert found == plain_terms(rows) and {r[2] for r in found} == {True, False} and any(len(r[0]) > 40 for r in found)
    vague = next(r[0] for r in found if not r[2] and not any(x[0] == r[0] and x[2] for x in found))
    clean = [r.sanitised or "" for r in pii.sanitise(docs).collect()]
    assert not any(f" {vague} " in t for t in clean) and any("[N.]" in t for t in clean) and not any("[[" in t for t in clean)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def check_licences(rows, found):
    assert len(rows) == len(found)
    for doc_id, text in rows.items():
        w, r = words(text), found[doc_id]
        places = sorted((i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        assert (r.n_words, r.n_base) == (len(w), len(places)), text
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_licences_on_a_whole_table(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = {r.doc_id: r for r in QUERIES["op7_license_scan"](spark, SF).collect()}
    check_licences(rows, found)
    for doc_id, text in rows.items():
        assert ("gpl-3" in found[doc_id].labels) == ("GNU General Public License, version 3" in (text or ""))


@pytest.mark.parametrize("common", [False, True])
def test_licences_on_odd_rows(spark, common):
    odd = [None, "", "---", "Released under the MIT\n\tLicense.", "UNDER THE MIT LICENSE under the mit license under the mit licenses", "Under_the mit-license; CC BY-NC 4.0 cc by ncé İunder the mit license", "Apache License, Version 2.0 " * 500,
           "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "redistribution of public goods", "license " * 3000]
    rows = odd + (["plain words only"] * 60 if common else [])
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, h string")
    found = {r.doc_id: r for r in licenses.scan(docs).collect()}
    check_licences(dict(enumerate(rows)), found)
    if common:
        assert found[7].labels == "bsd" and found[7].score > 0.9 and found[8].labels == "" and found[9].labels == ""
    assert licenses.scan(docs.limit(0)).count() == 0


@pytest.mark.parametrize("others", [0, 3, 30])
def test_licences_that_many_files_hold(spark, others):
    """Labels depend neither on the share of the files with a notice nor on the size of the table."""
    held = 1 if others == 0 else 20
    for t in (4, 8, 9, 10):
        name, notice, _ = licenses.TEMPLATES[t]
        docs = spark.createDataFrame([(i, f"file {i} {notice} end") for i in range(held)] + [(100 + i, f"plain words {i}") for i in range(others)], "doc_id long, text string")
        found = licenses.scan(docs).collect()
        assert {(r.doc_id < 100, r.labels) for r in found} == {(True, name)} | ({(False, "")} if others else set())
        assert all(r.score > 0.9 for r in found if r.doc_id < 100)
