"""The catalogue as a table: added patterns, their prefilters, and what every pattern finds."""
import re

import pytest

from shroud.functions import kernel as K
from shroud.functions import patterns as PT
from shroud.operators import detect


def rule(source, ci=False, rank=1000, name="OWN"):
    return PT.Pattern(rank, "pii", 100, name, source, ci)


def test_required_literals():
    assert K.literal(rule(r"\bticket-\d+\b")) == "ticket-"
    assert K.literal(rule(r"(?:a|b)TICKET", True)) == "ticket" and K.literal(rule(r"número \d")) == "mero "
    assert K.literal(rule(r"abc|abd")) in ("ab", "") and K.literal(rule(r"x*")) == "" and K.literal(rule(r"(?<=a{1,3})b")) == "b"
    texts = ["", "Ticket-1 ticket-22", "aTICKET bticket", "Número 3, número 4", "abd abc", "xx", "K\u212atİ ticket-7"]
    for p in (rule(r"\bticket-\d+\b"), rule(r"ticket-\d", True), rule(r"número \d"), rule(r"abc|abd"), rule(r"x*"), rule(r"[a-c]TICKET", True)):
        for text in texts:
            want = [m.span() for m in re.finditer(p.python, text, re.ASCII | (re.IGNORECASE if p.ci else 0)) if m.group()]
            assert [(s, e) for _, _, s, e, _ in K.pii_spans(text, (p,))] == want


def test_catalogue_table(spark):
    texts = spark.createDataFrame([(1, "ticket-12 for ana@example.org"), (2, None), (3, ""), (4, "ticket-x")], "doc_id long, text string")
    own = (1000, "pii", 100, "TICKET", r"\bticket-\d+\b", False)
    rows = spark.createDataFrame([own, *PT.patterns_rows()], PT.ROWS)
    got = {(r.doc_id, r.type, r.start, r.end, r.value) for r in detect.pii_spans(texts, patterns=rows).collect()}
    assert got == {(1, "TICKET", 0, 9, "ticket-12"), (1, "EMAIL", 14, 29, "ana@example.org")}
    first = spark.createDataFrame([(-1, "pii", 0, "NAME", "ana", False), *PT.patterns_rows()], PT.ROWS)
    assert [r.type for r in detect.pii_spans(texts, patterns=first).collect()] == ["NAME"]       # an earlier rule wins the overlap
    assert detect.pii_spans(texts, patterns=rows.where("type = 'SSN'")).count() == detect.pii_spans(texts, patterns=rows.limit(0)).count() == 0
    same = detect.pii_spans(texts, patterns=spark.createDataFrame(PT.patterns_rows(), PT.ROWS)).collect()
    assert same == detect.pii_spans(texts).collect()


def test_bad_catalogues_fail_early(spark):
    texts = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    with pytest.raises(Exception):
        detect.pii_spans(texts, patterns=spark.createDataFrame([(1, "pii", 1, "T", "(", False)], PT.ROWS))
    many = spark.range(detect.MOST_PATTERNS + 1).selectExpr("int(id) rank", "'pii' family", "int(id) idx", "'T' type", "concat('a', id) source", "false ci")
    with pytest.raises(ValueError):
        detect.pii_spans(texts, patterns=many)
