"""Personal data against plain regular expressions."""

import hashlib
import random
import re

import pytest
from pyspark.sql import types as T

from barwright.llm import pii

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def good(kind, s):
    d = re.sub("[^0-9]", "", s)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in s.split(".")),
            "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]


def brute(text):
    found = [(m.start(), i, k, m.end()) for i, (k, r) in enumerate(RULES.items()) for m in re.finditer(r, text) if good(k, m[0])]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(found)]


def base(text):
    return [f"{k}:{a}:{b}" for k, a, b, _ in pii.spans_of(text) if k in pii.BASE]


def test_random_texts_equal_plain_expressions():
    rng = random.Random(5)
    bits = ["a@b.c", "@", ".", "+", "1", "22", "255", "256", " ", "-", "(", ")", "x", "4111 1111 1111 1111", "1.2.3.4", "é", "%",
            "+1 (988) 555-2485", "0", "4041894974608795", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        assert base(text) == brute(text), text


@pytest.mark.parametrize("text, spans", [
    ("IBAN GB82 WEST 1234 5698 7654 32 ok", ["iban:5:32"]),
    ("IBAN GB83 WEST 1234 5698 7654 32 ok", []),
    ("call 555-123-4567 now", ["local_phone:5:17"]),
    ("part 555-123-4567 now", []),
    ("SSN 123-45-6789.", ["ssn:4:15"]),
    ("nr 123-45-6789.", []),
])
def test_added_kinds_need_checksum_or_context(text, spans):
    assert [f"{k}:{a}:{b}" for k, a, b, _ in pii.spans_of(text)] == spans


def test_long_runs_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1(" * 100_000, "a@" * 150_000, "1 " * 150_000):
        pii.spans_of(text)


def test_redaction():
    text = "to a@b.co or +1 (988) 555-2485"
    assert pii.redact(text, pii.spans_of(text)) == "to <email> or <phone>"


def test_nulls_repeats_and_extra_columns(spark):
    rows = [(1, "x a@b.co", "e"), (1, "x a@b.co", "e"), (None, None, None), (3, "", "z")]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("spans", T.StringType())])
    docs = spark.createDataFrame(rows, schema)
    got = {(r.doc_id, r.n_email, r.spans, r.base_sha256) for r in pii.report(pii.find_pii(docs)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {(1, 1, "email:2:8", sha("email:2:8")), (None, 0, "", sha("")), (3, 0, "", sha(""))}
    assert pii.report(pii.find_pii(docs)).count() == 4
    assert pii.report(pii.find_pii(docs.limit(0))).count() == 0
