import hashlib
import random
import re

import pytest

from factloom.llm import exact_dedup, line_dedup, pii
from tests.llm.conftest import ODD


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _no_python(df):
    plan = df._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_line_dedup(odd_docs, docs_of):
    rows = [(i, f" Shared\t\nown {i}\n\nÉa\n") for i in range(4)] + [(9, None), (4, "shared\nshared\nÉA"), (None, "x")]
    docs = docs_of(rows + [(4, "other\nSHARED ")])
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.text) for r in line_dedup.drop_repeated_lines(docs, 4, 1).collect())
    want = [(str(i), 5, 2, f"own {i}\n\n") for i in range(4)] + [("9", 1, 0, ""), ("None", 1, 0, "x")]
    # A-Z alone is put in lower case: É stays itself, so "Éa" and "ÉA" are one key.
    want += [("4", 3, 3, ""), ("4", 2, 1, "other")]
    assert got == sorted(want)
    _no_python(line_dedup.drop_repeated_lines(docs, 4, 1))
    # A document of many dropped lines, told apart from another text and an equal row of its id.
    long = "\n".join(f"{i % 7000}\n only {i}" for i in range(20_000))
    many = docs_of([(1, long), (1, "6\n only x"), (1, long), (2, "\n".join(map(str, range(7000)))), (None, "6"), (None, "zz")])
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.text) for r in line_dedup.drop_repeated_lines(many, 2, 1).collect())
    only = "\n".join(f" only {i}" for i in range(20_000))
    assert got == sorted([("1", 40_000, 20_000, only)] * 2 + [("1", 2, 1, " only x"), ("2", 7000, 7000, ""),
                                                             ("None", 1, 1, ""), ("None", 1, 0, "zz")])
    assert line_dedup.drop_repeated_lines(odd_docs, 100, 1).filter("n_dropped > 0").count() == 0
    assert line_dedup.drop_repeated_lines(odd_docs.limit(0), 2, 1).count() == 0


@pytest.mark.parametrize("block", [4, 4096])
def test_exact_dedup_against_brute_force(docs_of, monkeypatch, block):
    monkeypatch.setattr(exact_dedup, "BLOCK", block)
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab \n") for _ in range(rng.randrange(0, 40))) for _ in range(150)] + ODD
    rows = list(enumerate(texts)) + [(7, texts[7]), (None, texts[0]), (None, "alone"), (None, "alone")]
    docs = docs_of(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    got = exact_dedup.exact_groups(docs).collect()
    _no_python(exact_dedup.exact_groups(docs))
    assert len(got) == len(rows)
    by_sha = {_sha(t): ids for t, ids in groups.items()}
    for r in got:
        ids = by_sha[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids) and r.keep_id == (min(known) if known else None)
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0


def _base(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                    "card": 16 <= len(digits) <= 19 and _luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_against_plain_patterns(docs_of, spark):
    rng = random.Random(5)
    parts = ["a@b.c", "_d@e.f", "x.y+z@q-w.de.", "1.2.3.4", "256.1.1.1", "001.02.3.004", "4111 1111 1111 1111",
             "4111-1111-1111-1112", "5500005555555559", "0", "9", "-", " ", ".", "@", "+49 (0)30 1234567", "+1", "é", "🙂",
             "+12345678", "\n", "4", "DE89 3704 0044 0532 0130 00", "ssn 123-45-6789 ", "..", "a"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 14))) for _ in range(1500)] + ODD
    docs = docs_of(list(enumerate(texts)))
    found = pii.scan(docs)
    _no_python(found)
    for r in found.collect():
        want = _base(texts[r.doc_id] or "")
        assert r.base_sha256 == _sha(",".join(want)), texts[r.doc_id]
        spans = r.spans.split(",") if r.spans else []
        assert spans[:len(want)] == want and all(s.split(":")[0] in ("iban", "ssn") for s in spans[len(want):])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in BASE]
    assert pii.scan(docs.limit(0)).count() == 0


def test_pii_checks_and_masking(docs_of):
    from pyspark.sql import functions as F

    texts = ["IBAN DE89370400440532013000 ok", "IBAN DE89370400440532013001 no", "my ssn 123-45-6789", "no 123-45-6789",
             "mail a@b.cd or call +49 30 1234567!", None]
    spans = pii.find_spans(F.col("text"))
    rows = {r.doc_id: r for r in docs_of(list(enumerate(texts))).select(
        "doc_id", pii.listed(spans).alias("s"), pii.masked(F.col("text"), spans).alias("m")).collect()}
    assert rows[0].s == "iban:5:27" and rows[1].s == "" and rows[2].s == "ssn:7:18" and rows[3].s == ""
    assert rows[4].m == "mail [EMAIL] or call [PHONE]!" and rows[5].m is None and rows[0].m == "IBAN [IBAN] ok"


def test_pii_words_behind_an_iban_stay_outside(docs_of):
    from pyspark.sql import functions as F

    known = ["ES91 2100 0418 4502 0005 1332", "AT61 1904 3002 3457 3201", "BE68 5390 0754 7034", "NO93 8601 1117 947",
             "CZ65 0800 0000 1920 0014 5399", "SE45 5000 0000 0583 9825 7466", "PL61 1090 1014 0000 0712 1981 2874",
             "RO49 AAAA 1B31 0075 9384 0000", "DE89 3704 0044 0532 0130 00", "FR14 2004 1010 0505 0001 3M02 606",
             "MT84 MALT 0110 0001 2345 MTLC AST0 01S", "LC55 HEMM 0001 0001 0012 0012 0002 3015"]
    known += [k.replace(" ", "") for k in known]
    behind = ["", " BIC CAIXESBB", " EUR", " BIC", " A", " AMOUNT 1234", ", EUR", " ES91 2100 0418 4502 0005 1332"]
    texts = [(k, b) for k in known for b in behind]
    spans = pii.find_spans(F.col("text"))
    got = {r.doc_id: (r.s, r.m) for r in docs_of([(i, f"to {k}{b}") for i, (k, b) in enumerate(texts)]).select(
        "doc_id", pii.listed(F.filter(spans, lambda s: s["kind"] == "iban")).alias("s"),
        pii.masked(F.col("text"), F.filter(spans, lambda s: s["kind"] == "iban")).alias("m")).collect()}
    for i, (k, b) in enumerate(texts):
        at = len(k) + 4
        second = f",iban:{at}:{at + len(b) - 1}" if b.startswith(" ES91") else ""
        assert got[i] == (f"iban:3:{len(k) + 3}{second}", "to [IBAN]" + (" [IBAN]" if second else b)), texts[i]
