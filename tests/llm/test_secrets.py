"""Secret scans against plain regular expressions, and the linking rules case by case."""

import hashlib
import re

import pytest

from hedgemark.llm import secrets


def plain_base(text):
    found = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, "assign", m.end()))
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_base_spans_like_plain(odd_docs, sample):
    docs = odd_docs.unionByName(sample, allowMissingColumns=True)
    expected = []
    for r in docs.collect():
        spans = plain_base(r.text or "")
        listed = ",".join(f"{k}:{s}:{e}" for s, _, k, e in spans)
        counts = tuple(sum(k == kind for _, _, k, _ in spans) for kind in ("assign", "access", "hex"))
        expected.append((r.doc_id, *counts, hashlib.sha256(listed.encode()).hexdigest()))
    found = secrets.scan(docs, ["doc_id"]).drop("spans", "parts").collect()
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)


KEY = "aB3dE5fG7hJ9kL1mN3pQ5rS7"


@pytest.mark.parametrize(("text", "kinds"), [
    (f"login: alice {KEY}", ["identifier", "secret"]),
    ("login: alice and nothing else", []),
    (f"see {KEY} here: no account", []),
    (f"host=db.example.com login=bob {KEY}", ["endpoint", "identifier", "secret"]),
    ("host=db.example.com password=hunter2hunter2", ["assign"]),
    (f"host=db.example.com {KEY}", []),
    (f"login: alice\n\n{KEY}", []),
    (f"login: alice {'x ' * 150}{KEY}", []),
    (f"login: alice {'x ' * 90}{KEY}", ["identifier", "secret"]),
    ("AKIA" + "C" * 16 + f" = {KEY}", ["access", "secret"]),
    ("user=bob password: s3cr3tpass", ["identifier", "assign"]),
])
def test_weak_parts_need_their_complement(spark, text, kinds):
    row = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), ["doc_id"]).first()
    assert [x.split(":")[0] for x in row.spans.split(",") if x] == kinds


def test_many_parts_in_one_text(spark):
    text = f"login: alice {KEY}\n" * 3000
    row = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), ["doc_id"]).first()
    assert len(row.parts) == 6000


def test_redacted_texts_hold_no_part(odd_docs, sample):
    docs = sample.unionByName(odd_docs.select("doc_id", "text"), allowMissingColumns=True)
    before, after = docs.collect(), secrets.redact(docs).collect()
    assert secrets.redact(docs).columns == docs.columns
    assert len(before) == len(after)
    assert all(not plain_base(r.text or "") for r in after)
    clean = [tuple(r) for r in before if not plain_base(r.text or "") and "login" not in (r.text or "")]
    assert set(clean) <= {tuple(r) for r in after}


def test_no_documents(empty_docs):
    assert secrets.scan(empty_docs, ["doc_id"]).count() == 0
    assert secrets.redact(empty_docs).count() == 0
