import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0,
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), list(PATTERNS).index(kind), m.end(), kind))
    return [(a, b, k) for a, _, b, k in sorted(out)]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="01239.@+-a_ ()é:/%", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert [s for s in pii.Finder().spans(text) if s[2] in pii.BASE] == brute(text)


def test_planted_and_added_kinds():
    text = "é a.b@c.de, 10.0.0.1; 4111 1111 1111 1111 +1 (988) 555-2485 https://x.org/a?b=1. IBAN: GB82 WEST 1234 5698 7654 32 password=7602ad27cf55"
    got = pii.Finder().spans(text)
    assert [s for s in got if s[2] in pii.BASE] == brute(text)
    assert {text[a:b] for a, b, k in got if k in ("url", "account")} == {"https://x.org/a?b=1", "GB82 WEST 1234 5698 7654 32", "7602ad27cf55"}
    assert "4111" not in pii.mask(text, got) and pii.mask(text, []) == text


def test_report_defines_odd_rows(spark):
    rows = [(1, None, "x"), (None, "", "x"), (2, "m@n.op", "x"), (2, "m@n.op", "x"), (3, "z" * 200_000 + "@b.cc", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted(map(tuple, pii.report(df).select("doc_id", "n_email", "spans", "base_sha256").collect()), key=str)
    empty = hashlib.sha256(b"").hexdigest()
    assert (1, 0, "", empty) in got and (None, 0, "", empty) in got
    assert [g[:3] for g in got if g[0] == 2] == [(2, 1, "email:0:6")] * 2
    assert [g[1] for g in got if g[0] == 3] == [1]
    assert pii.report(df.limit(0)).count() == 0
    assert pii.redact(df).where("doc_id = 2").first().text == "[EMAIL]"
