"""Personal data: base spans against Python's regular expressions, discovery on planted contexts."""

import hashlib
import random
import re

import pytest

from framewright.llm import pii

SCHEMA = "doc_id long, text string, spans string, kind int, row string"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def check(spark, texts):
    rows = [(i, t, "x", 1, "x") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = plain(t)
        line = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest(), (t, got[i].spans, line)
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(k == kind for k, *_ in want) for kind in PLAIN]
        assert set(line.split(",")) <= set(got[i].spans.split(",")) if line else True
        assert got[i].spans.count(":") // 2 == len(want) + got[i].n_added
    return got


CARD, OTHER = "4242 4242-4242 4242", "4111111111111111"


def test_base(spark):
    texts = [None, "", " ", "a@b.c_x@d.e", "a@b.c.@d.e f@g", "é😀 a.b+c@x-y.co.uk, 1.2.3.4.5.6.7.8.9 256.1.1.1 0255.001.1.1", "1.2.3", CARD + OTHER, f"x{CARD}. {OTHER} 4242424242424243"]
    texts += ["+1 (487) 555-7209 4242424242424242", "++12 345-67-89.", "+1234567", "+12 (((", "5" * 30000, "7 " * 20000, "1." * 9000, "a" * 50000 + "@", "a@b." * 4000, "x@y.z" * 3000, "9-" * 5000]
    r = random.Random(5)
    pieces = ["a@b.co", "1.2.3.4", "300.1.1.1", "4242424242424242", "+49 (30) 1234-5678", "+", "@", ".", "-", " ", "é", "😀", "12", "7", "x", "_", "\n", "(", ")"]
    texts += ["".join(r.choice(pieces) for _ in range(r.randint(1, 25))) for _ in range(400)]
    check(spark, texts)


def test_edges(spark):
    assert pii.report(spark.createDataFrame([], SCHEMA)).count() == 0
    same = [(None, "write to a@b.co", "x", 1, "x")] * 3
    assert [r.n_email for r in pii.report(spark.createDataFrame(same, SCHEMA)).collect()] == [1, 1, 1]


def test_discovery(spark):
    """Patterns learnt from seeds find identifiers of other forms; a second round goes on from these; ordinary numbers stay."""
    r = random.Random(2)
    texts = [f"filler {w} please write to user{i}@mail{i}.example.com today" for i, w in enumerate("abcdefghijkl")]
    texts += ["we said please write to bob (at) example (dot) com today", "now please write to root@localhost today"]
    # Only the second round can trust this pattern: its instances are those just found and no seed's.
    texts += [f"please write to agent{i}@intranet today" for i in range(4)] + [f"reach agent{i}@intranet here" for i in range(4)] + ["reach agent9@intranet here"]
    texts += [f"order number {r.randint(10**15, 10**16 - 1)} shipped {i}" for i in range(40)] + [f"in the year {1900 + i} we" for i in range(60)]
    texts += [f"order number {CARD} shipped"] * 5
    got = check(spark, texts)
    spans = lambda t: {t[int(s) : int(e)] for _, s, e in (x.split(":") for x in got[texts.index(t)].spans.split(",") if x)}
    assert spans(texts[12]) == {"bob (at) example (dot) com"} and spans(texts[13]) == {"root@localhost"}
    assert spans("reach agent9@intranet here") == {"agent9@intranet"}
    for t, g in ((t, got[i]) for i, t in enumerate(texts)):
        if t.startswith(("order", "in the")):
            assert g.n_added == 0


def test_no_python_workers(spark):
    plan = pii.report(spark.createDataFrame([(1, "a@b.co", "", 1, "")], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("kind", pii.KINDS)
def test_forms_hold_no_ordinary_words(kind):
    for text in ("in 2020", "page 12", "3.5", "10%", "v1.2"):
        assert not re.match(pii.FORMS[kind], text)
