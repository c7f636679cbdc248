from __future__ import annotations

import hashlib
import random
import re

import pytest

from ledgerflow.llm import pii
from ledgerflow.llm.common import table
from ledgerflow.llm.queries import op2_pii

SF = "/root/testdata/sf0.01"

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def slow_base(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


def check(texts, got):
    for r in got:
        base = slow_base(texts[r["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(b[0] == k for b in base) for k in PLAIN], r
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        spans = [tuple(s.split(":")) for s in r["spans"].split(",")] if r["spans"] else []
        assert {(k, str(a), str(b)) for k, a, b in base} <= set(spans)
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), int(s[1])))


def test_query_against_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    got = op2_pii(spark, SF).collect()
    assert len(got) == len(texts) and sum(r["n_email"] for r in got) > 5
    check(texts, got)


def noise(draw):
    pieces = ["a@b.c", "x.y@d-e.co.uk", "@", ".", "+", "1", "12", " ", "-", "(", ")", "255", "256", "10.0.0.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "\u00e9", "\U0001f600",
              "+1 (961) 555-6946", "a", "_", "\n", "5500-0000-0000-0004", "00000000000000000000001.2.3.4", "999999999999.1.1.1", "a@b.c_d@e.f", "%"]
    return "".join(draw.choice(pieces) for _ in range(draw.randint(0, 40)))


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, base string, spans int")
    found = pii.personal_data(docs)
    return [(r["doc_id"], [tuple(s) for s in r["base"]], [tuple(s) for s in r["spans"]]) for r in found.collect()]


def test_base_spans_of_noise(spark):
    draw = random.Random(11)
    texts = {i: noise(draw) for i in range(1500)}
    for i, base, spans in run(spark, list(texts.items())):
        assert base == slow_base(texts[i]), texts[i]
        assert set(base) <= set(spans)


def test_odd_rows(spark):
    many = " ".join(f"u{i}@h{i % 7}.org" for i in range(3000))
    rows = [(0, None), (1, ""), (2, "a" * 400_000), (3, "1" * 400_000), (4, many), (5, "." * 300_000), (6, "x@" + "y." * 100_000), (7, "same a@b.cd"), (7, "same a@b.cd"), (None, "n@o.id"), (8, "+1" + " " * 200_000)]
    got = run(spark, rows)
    assert len(got) == len(rows)
    # The plain expressions take quadratic time on the longest of these.
    expected = {2: [], 3: [], 5: [], 6: [("email", 0, 200_001)], 8: []}
    texts = dict(rows)
    assert all(base == (expected[i] if i in expected else slow_base(texts[i])) for i, base, _ in got)
    assert run(spark, []) == []


def test_the_method_adds_spans(spark):
    texts = {
        1: "Please call (212) 555-0187 today", 2: "write to jane.doe (at) example (dot) com", 3: "address fe80:0:0:0:1:2:3:4 here", 4: "dear Mr. John Smith, hello",
        5: "nothing 12 here at all", 6: "my ssn 123-45-6789 ok", 7: "iban DE89 3704 0044 0532 0130 00",
    }
    found = {i: (base, spans) for i, base, spans in run(spark, list(texts.items()) * 3)}
    kinds = {i: [s[0] for s in spans] for i, (_, spans) in found.items()}
    assert kinds[5] == [] and kinds[1] == ["phone"] and kinds[2] == ["email"] and kinds[6] == ["ssn"] and kinds[7] == ["iban"] and kinds[4] == ["person"]
    kind, start, end = found[1][1][0]
    assert texts[1][start:end] == "(212) 555-0187"


def test_estimation_finds_the_better_labeler():
    draw = random.Random(1)
    counted = {}
    for _ in range(4000):
        true = draw.random() < 0.6
        votes = tuple(int(true) if draw.random() < right else int(not true) for right in (0.95, 0.9, 0.85, 0.6))
        counted[votes] = counted.get(votes, 0) + 1
    patterns = [{"kind": "email", "size": 1, **dict(zip(pii.LABELERS, v)), "n": n} for v, n in counted.items()]
    chances, yes = pii.reliabilities(patterns)
    assert yes["form"][0] > 0.9 > yes["border"][0] and yes["form"][1] < 0.12
    weights = pii.span_classifier(patterns, chances)
    assert weights["form=1"] > weights["form=0"]
    assert weights["form=1"] - weights["form=0"] > weights["border=1"] - weights["border=0"]


def test_native_plan(spark):
    df = pii.proposals(table(spark, SF, "documents"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("text, masked", [
    ("mail a.b@c.org, or +1 (961) 555-6946!", "mail [EMAIL], or [PHONE]!"), ("4111 1111 1111 1111", "[CARD]"), (None, None), ("clean", "clean"), ("\U0001f600 1.2.3.4", "\U0001f600 [IP]"),
])
def test_redaction(spark, text, masked):
    docs = spark.createDataFrame([(1, text, "k"), (1, text, "k")], "doc_id long, text string, spans string")
    got = pii.redacted(docs)
    assert got.columns == docs.columns
    assert [tuple(r) for r in got.collect()] == [(1, masked, "k")] * 2


def test_iban_check_digits(spark):
    good = ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "FR1420041010050500013M02606", "MT84MALT011000012345MTLCAST001S"]
    bad = ["DE12ABCD3456EF78", "DE88370400440532013000", "GB82 WEST 1234 5698 7654 23", "FR1420041010050500013M02607"]
    rows = [(i, f"my iban is {code} here") for i, code in enumerate(good + bad)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    forms = {r["id"]: [f["form"] for f in r["found"] if f["kind"] == "iban"] for r in pii.proposals(docs).collect()}
    assert forms == {i: [int(i < len(good))] for i in range(len(rows))}
    spans = {r["doc_id"]: [s for s in r["spans"] if s["kind"] == "iban"] for r in pii.personal_data(docs).collect()}
    assert not any(spans[i] for i in range(len(good), len(rows)))


def test_spans_far_apart_and_over_pages(spark):
    draw = random.Random(3)
    texts = []
    for _ in range(30):
        parts = ["\u00e4" * draw.choice([0, 1, 50, 4090, 4096, 9000]) + " " + draw.choice(["ab@cd.org", "+49 30 1234567", "8.8.8.8", "030-123-4567"]) + " " for _ in range(draw.randint(1, 12))]
        texts.append("".join(parts) + "end")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs).collect()}
    for r in pii.redacted(docs).collect():
        text, out, at = texts[r["doc_id"]], [], 0
        for s in sorted(spans[r["doc_id"]], key=lambda s: (s["start"], -s["end"])):
            if s["start"] >= at:
                out += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
            at = max(at, s["end"])
        assert r["text"] == "".join(out) + text[at:]
