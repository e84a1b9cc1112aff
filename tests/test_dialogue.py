"""Detection over joined messages and leaks across turns, against plain recomputation."""
import random

import pytest
from pyspark.sql import functions as F

from shroud.functions import kernel
from shroud.operators import flattened as FL
from shroud.operators import leaks as LK
from shroud.operators import mask as MK

PIECES = ["4111 1111", "2222 3333", "4111", "1111 2222 3333", "12345678", "Z", "X1234567", "routing", "my routing number is", "123456789", "ES12", "ABCD EFGH", "IJKL MNOP QRST UVWX", "1234", "28", "1234567890", "07",
          "600 123", "456", "600123456", "+34", "555-123-4567", "a@b.co", "a@b", ".co m", "MRN", "12345", "ICAM nº", "REF-", "20/01/2024", "", " ", "\n", " ", "palabra suelta", "and then we talked about the weather for a very long time indeed, nothing else at all,",
          "so that there is room enough between one number and the next one to be sure of it, and more", "AB", "é", "\U0001F600", "280001", "C 000012/2020", "B1234567", "8"]


def plain(rows):
    texts = {}
    for conv, turn, text in sorted(rows, key=lambda r: r[:2]):
        texts.setdefault(conv, []).append(text or "")
    return sorted((c, *s) for c, t in texts.items() for s in kernel.pii_spans(" ".join(t)))


def spans(df):
    return sorted((r.conv_id, r.rank, r.type, r.start, r.end, r.value) for r in FL.request_spans(df).collect())


@pytest.mark.parametrize("block", [16, 200, 4096])
def test_spans_equal_those_of_the_joined_text(spark, monkeypatch, block):
    monkeypatch.setattr(FL, "BLOCK", block)
    r = random.Random(block)
    rows = [(c, t, None if r.random() < 0.03 else r.choice(["", " "]).join(r.choice(PIECES) for _ in range(r.randrange(6)))) for c in range(60) for t in range(r.randrange(1, 40))]
    want = plain(rows)
    assert spans(spark.createDataFrame(rows, "conv_id long, turn int, text string")) == want
    assert len(want) > 300


def test_quiet_blanks_are_safe():
    """No match changes when a text is cut at a quiet blank."""
    r, cuts = random.Random(9), 0
    for _ in range(4000):
        text = " ".join(r.choice(PIECES) for _ in range(r.randrange(2, 30)))
        got = FL.quiet_range(text)
        if got:
            cuts += 1
            a, b = got
            parts = [(0, text[:a]), (a, text[a:b]), (b, text[b:])]
            assert sorted((k, t, s + o, e + o, v) for o, p in parts for k, t, s, e, v in kernel.pii_spans(p)) == sorted(kernel.pii_spans(text))
    assert cuts > 500


def test_a_long_conversation_is_split(spark):
    n = 20_000
    df = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "concat('turn number ', CASE WHEN id % 50 = 0 THEN '4111 1111' WHEN id % 50 = 1 THEN '2222 3333 it was' ELSE 'word and word' END, ' and so on it went') AS text")
    scanned = FL._scan_blocks(FL.text_blocks(df, "conv_id", "turn", "text"), "conv_id")
    sizes = FL.chains(scanned, "conv_id").select(F.length("text").alias("n")).agg(F.count("n"), F.max("n")).first()
    assert sizes[0] > 100 and sizes[1] < 3 * FL.BLOCK
    split = df.withColumn("text", F.regexp_replace("text", "^turn number 2222", "2222")).withColumn("text", F.regexp_replace("text", "1111 and so on it went$", "1111"))
    found = FL.request_verdicts(split).first()
    assert found.detected and found.matches == n // 50 and found.types == ["CARD"]


def test_edges(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, ""), (2, 0, "plain"), (None, 0, "a@b.co"), (3, None, "a@b.co"), (4, 0, "x" * 20_000 + " a@b.co")], "conv_id long, turn int, text string")
    got = {r.conv_id: (r.detected, r.matches, r.types) for r in FL.request_verdicts(df).collect()}
    assert got == {1: (False, 0, []), 2: (False, 0, []), 4: (True, 1, ["EMAIL"])}
    assert FL.request_verdicts(df.where("conv_id > 9")).count() == 0


def test_leaks_across_turns(spark):
    r = random.Random(5)
    rows = []
    for c in range(12):
        known = [f"{100000000 + r.randrange(10 ** 8)}" for _ in range(30)]
        for t in range(40):
            v = r.choice(known)
            rows.append((c, t, r.choice([f"routing {v} and a{t}@b.co", f"it was ({v}), not x{v}", "nothing", None, f"routing {v}, yes ({v[:-1]})"]), "user"))
    masked = MK.anonymize(spark.createDataFrame(rows, "conv_id long, turn int, text string, role string"))
    every = masked.collect()
    want = set()
    for x in every:
        for y in every:
            if x.conv_id == y.conv_id:
                want |= {(y.conv_id, y.turn, t.type, t.value) for t in x.tokens if t.value and t.value in (y.masked or "")}
    assert len(want) > 20
    for values, turns in ((4096, 256), (3, 7)):                  # several automata and chunks a conversation
        got = [tuple(r) for r in LK.conversation_leaks(masked, values=values, turns=turns).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert LK.conversation_leaks(masked.where("conv_id < 0")).count() == 0
