"""Spans on the JVM against masking one text after the other: each type, valid and invalid, side by side, overlapping, in odd text."""

import random
from collections import Counter

import plain_pii
import pytest

from corpusloom.operators import safety

BITS = [
    "ABCDE1234F", "abcde1234f", "a.b+c@d-e.org", "né@ü.de", "@x", "EMP-12345", "emp_1", "Cust42424", "CUST-1", "4111 1111 1111 1111", "4111111111111112", "4111-1111-1111-1111", "1234 5678 9012", "123456789012",
    "12 Long Street, Town 560001", "9 Elm rd. x 12345", "+1 555 123 4567", "(040) 2345 6789", "123-4567", "12345", "123456789", "123456789012345678", "1234567890123456789", "٣٤٥٦٧٨٩", "x1y2", "日本 4111111111111111 語", "é", ".", ",", "\n", "word", "'",
]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(12)
    return [None, "", "no digits", *BITS, *[" ".join(rnd.choice(BITS) for _ in range(rnd.randint(2, 25))) for _ in range(150)], "w " * 20000 + "mail me@you.org " + "w " * 20000]


def test_spans(spark, texts):
    d = spark.createDataFrame([(i, t, "m", ["a", "b"][i % 2]) for i, t in enumerate(texts)], "i int, text string, masked string, s string").repartition(3)
    df = safety.mask(d)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    seen, rows, spans = set(), Counter(), Counter()
    for r in df.collect():
        want, types = plain_pii.mask_text(r.text or "")
        assert (r.masked, r.pii_types) == (want if r.text is not None else None, types), r.text
        at, out = 0, []
        for s in r.pii_spans:
            out += [r.text[at : s.start], f"[{s.type}_REDACTED]"]
            at = s.end
        assert "".join([*out, (r.text or "")[at:]]) == (r.masked or "")
        seen.update(types)
        rows.update((r.s, t) for t in types)
        spans.update((r.s, x.type) for x in r.pii_spans)
    assert seen == set(safety.PII)
    assert {(r.s, r.type): (r.n_spans, r.n_rows) for r in safety.pii_counts(d, "s").collect()} == {k: (spans[k], rows[k]) for k in rows}
