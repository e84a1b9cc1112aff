"""Stateful streams over several micro-batches: late, repeated and out-of-order rows."""
from datetime import datetime

from pyspark.sql import functions as F

from shroud.session import ensure_checkpoint_dir
from shroud.streaming import stream as ST


def arriving(spark, tmp_path, schema, batches):
    """A stream with one micro-batch for each list of rows."""
    path = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_quota_labels_late_rows_and_follows_the_user_over_tiers(spark, tmp_path):
    at = lambda day, hour: datetime(2024, 5, day, hour)
    batches = [
        [(1, at(1, 9), "u", "free"), (2, at(1, 8), "u", "free"), (3, at(1, 9), "v", "pro")],
        [(4, at(1, 7), "u", "pro"), (5, at(4, 1), "u", "pro")],
        [(6, at(1, 23), "u", "pro"), (7, at(3, 1), "u", "free"), (8, at(4, 2), "u", "free"), (9, at(1, 10), "v", "pro")],
        [(10, at(4, 3), "u", "free")],
    ]
    s = arriving(spark, tmp_path, "request_id long, ts timestamp, kp_user_id string, kp_tier string", batches)
    out = ST.run_to_table(ST.rate_limit_stream(s, {"free": 2, "pro": 3}), "quota").collect()
    got = {r.request_id: (r.user_id, r.rl_seq, r.rl_allowed, r.late) for r in out}
    assert len(out) == 10 and got == {
        1: ("u", 2, True, False), 2: ("u", 1, True, False), 3: ("v", 1, True, False),
        4: ("u", 3, True, False), 5: ("u", 1, True, False),
        6: ("u", None, False, True), 7: ("u", 1, True, False), 8: ("u", 2, True, False), 9: ("v", 2, True, False),
        10: ("u", 3, False, False),
    }


def test_chunks_in_any_order(spark, tmp_path):
    batches = [
        [("a", 1, 0, "x[EM", False), ("a", 1, 2, "_1]", True), ("b", 2, 0, "whole", True)],
        [("a", 1, 1, "AIL", False), ("c", 3, 1, "never", False), ("b", 2, 0, "whole", True)],
        [("d", 4, 1, None, True), ("a", 1, 1, "AIL", False)],
        [("d", 4, 0, "z", False)],
    ]
    s = arriving(spark, tmp_path, "resp_id string, conv_id long, chunk_no int, text string, is_last boolean", batches)
    out = ST.run_to_table(ST.reassemble_stream(s), "chunks").collect()
    assert sorted(tuple(r) for r in out) == [("a", 1, "x[EMAIL_1]", True), ("b", 2, "whole", True), ("d", 4, "z", True)]


def test_numbers_go_on_over_micro_batches(spark, tmp_path):
    batches = [[(1, 0, "a@example.com"), (2, 0, "none")], [(1, 1, "b@example.com")], [(1, 2, "c@example.com"), (2, 1, "d@example.com")]]
    s = arriving(spark, tmp_path, "conv_id long, turn long, text string", batches)
    out = ST.run_to_table(ST.conversation_mask_stream(s), "masks").collect()
    assert sorted((r.conv_id, r.turn, r.masked) for r in out) == [(1, 0, "[EMAIL_1]"), (1, 1, "[EMAIL_2]"), (1, 2, "[EMAIL_3]"), (2, 0, "none"), (2, 1, "[EMAIL_1]")]


def test_update_mode_and_a_stream_without_rows(spark, tmp_path):
    batches = [[(datetime(2024, 5, 1, 9, 1), "x", 1.0)], [(datetime(2024, 5, 1, 9, 2), "x", 2.0)], [(datetime(2024, 5, 1, 10), "x", 4.0)]]
    s = arriving(spark, tmp_path, "ts timestamp, event_type string, value double", batches)
    out = ST.run_to_table(ST.usage_windows(s), "usage", ["window_start", "event_type"]).collect()
    assert sorted((r.window_start.hour, r.events, r.value_sum) for r in out) == [(9, 2, 3.0), (10, 1, 4.0)]
    assert ST.run_to_table(ST.usage_windows(s.where(F.lit(False))), "none", ["window_start", "event_type"]).count() == 0
    assert ensure_checkpoint_dir(spark)


def test_cache_skips_repeated_texts_for_an_hour(spark, tmp_path):
    """Repeats within the hour and after it, in the same micro-batch and in later ones; failures and findings aren't kept."""
    at = lambda hour, minute=0: datetime(2024, 5, 1, hour, minute)
    batches = [
        [(1, at(9), "hello", "clean"), (2, at(9, 59), "hello", "error"), (3, at(10), "hello", "found"), (4, at(10, 1), "hello", "clean"), (5, at(9), "risky", "found"), (6, at(9, 1), "risky", "error"), (7, at(9), None, "clean")],
        [(8, at(11), "hello", "clean"), (9, at(11, 1), "hello", "clean"), (10, at(9, 2), "risky", "clean"), (11, at(9, 3), "risky", "found"), (12, at(9, 30), "", "found"), (13, None, "hello", "clean")],
        [(14, at(12), "hello", "error"), (15, at(12, 1), "hello", "error"), (16, at(12, 2), "hello", None), (17, at(8), "risky", "found"), (18, at(10, 2), "risky", "found")],
    ]
    s = arriving(spark, tmp_path, "request_id long, ts timestamp, text string, ner_status string", batches)
    out = ST.run_to_table(ST.clean_cache_skips(s), "skips").collect()
    got = {r.request_id: (r.asked, r.ner_status) for r in out}
    skipped = (False, "clean")
    assert len(out) == 17 and got == {
        1: (True, "clean"), 2: skipped, 3: (True, "found"), 4: (True, "clean"), 5: (True, "found"), 6: (True, "error"), 7: (True, "clean"),
        8: skipped, 9: (True, "clean"), 10: (True, "clean"), 11: skipped, 12: skipped,
        14: skipped, 15: (True, "error"), 16: (True, "error"), 17: skipped, 18: (True, "found")}


def test_cached_until_equals_a_plain_loop():
    import random

    import numpy as np

    r = random.Random(3)
    for _ in range(300):
        ts = sorted(r.randrange(100) for _ in range(r.randrange(40)))
        clean = [r.random() < 0.6 for _ in ts]
        until = start = r.choice([-1 << 62, r.randrange(60)])
        want = []
        for t, c in zip(ts, clean, strict=True):
            want.append(t >= until)
            if want[-1] and c:
                until = t + 15
        asked, last = ST.cached_until(np.array(ts, np.int64), np.array(clean, bool), start, 15)
        assert asked.tolist() == want and last == until


def test_pieces_come_before_the_end(spark, tmp_path):
    """Whole tokens only, in order, as early as they can; repeated, early and late chunks; the rest stays open."""
    batches = [
        [("a", 1, 0, "Dear [PERS", False), ("b", 2, 2, "[x] [A", False), ("c", 3, 0, None, True), ("d", 4, 0, "[EMAIL_1", False)],
        [("a", 1, 1, "ON_1], [EMAIL_", False), ("a", 1, 0, "Dear [PERS", False), ("b", 2, 1, "two ", False), ("d", 4, 1, "2] and", False)],
        [("a", 1, 3, "2].", True), ("b", 2, 0, "one ", False), ("c", 3, 1, "beyond", False)],
        [("a", 1, 2, "1", False), ("b", 2, 3, "B_1]", True)],
    ]
    s = arriving(spark, tmp_path, "resp_id string, conv_id long, chunk_no int, text string, is_last boolean", batches)
    got = {}
    for r in sorted(ST.run_to_table(ST.piece_stream(s), "pieces").collect()):
        got.setdefault(r.resp_id, []).append((r.piece_no, r.text, r.end))
    assert got == {
        "a": [(0, "Dear ", "more"), (1, "[PERSON_1], ", "more"), (2, "[EMAIL_12].", "last")],
        "b": [(0, "one two [x] ", "more"), (1, "[AB_1]", "last")],
        "c": [(0, "", "last")],
        "d": [(0, "[EMAIL_12] and", "more")],
    }


def test_closed_part_never_cuts_a_token():
    import random

    from shroud.functions.kernel import TOKEN_RE
    r = random.Random(2)
    for _ in range(3000):
        text = "".join(r.choice(["[", "]", "EMAIL", "_", "1", "22", " ", "a", "[EMAIL_3]", "[DNI_"]) for _ in range(r.randrange(12)))
        cut = r.randrange(len(text) + 1)
        k = ST.closed_part(text[:cut])
        assert not any(m.start() < k < m.end() for m in TOKEN_RE.finditer(text))


def test_both_quotas_in_one_state(spark, tmp_path):
    at = lambda day, hour: datetime(2024, 5, day, hour)
    batches = [
        [(1, at(1, 9), "u", "free", None, True), (2, at(1, 8), "u", "free", None, False), (3, at(1, 10), "u", "free", None, True), (4, at(1, 11), "u", "free", None, True), (5, at(1, 9), "v", "odd", 1, True)],
        [(6, at(1, 12), "v", "odd", 1, True), (7, at(2, 1), "u", "pro", None, True), (8, at(2, 2), "u", "pro", 0, True)],
        [(9, at(5, 1), "u", "pro", None, None), (10, at(2, 3), "u", "pro", None, True)],
        [(11, at(2, 4), "u", "pro", None, True)],
    ]
    s = arriving(spark, tmp_path, "request_id long, ts timestamp, kp_user_id string, kp_tier string, kp_edge_limit int, wants_edge boolean", batches)
    out = ST.run_to_table(ST.quota_stream(s, {"free": 3, "pro": 9}, {"free": 1, "pro": 2}, 50), "both").collect()
    got = {r.request_id: (r.rl_seq, r.rl_allowed, r.edge_seq, r.edge_allowed, r.late) for r in out}
    assert len(out) == 11 and got == {
        2: (1, True, None, None, False), 1: (2, True, 1, True, False), 3: (3, True, 2, False, False), 4: (4, False, None, None, False),
        5: (1, True, 1, True, False), 6: (2, True, 2, False, False), 7: (1, True, 1, True, False), 8: (2, True, 2, False, False),
        9: (1, True, None, None, False), 10: (3, True, 3, False, False), 11: (None, False, None, None, True)}


class Held:
    """A group's state as ``applyInPandasWithState`` gives it."""
    def __init__(self, now=0, value=None, timed_out=False):
        self.now, self.value, self.hasTimedOut, self.exists, self.wait = now, value, timed_out, value is not None, None

    get = property(lambda self: self.value)

    def getCurrentProcessingTimeMs(self):
        return self.now

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, ms):
        self.wait = ms


def test_responses_that_share_a_group_end_by_themselves():
    """One call serves all responses of a bucket; each is given up after its own hour, whether others go on or not."""
    import pandas as pd

    cols = ["resp_id", "conv_id", "chunk_no", "text", "is_last"]
    for take, gone, first, cut in [(ST._h6, ST._h6_gone, [("b", 2, "whole", True)], [("a", 1, "xz", False)]),
                                   (ST._pieces, ST._pieces_gone, [("a", 1, 0, "x", "more"), ("b", 2, 0, "whole", "last")], [("a", 1, 1, "z", "cut")])]:
        run = ST._bucket_factory("resp_id", take, gone, 1000)
        state = Held(now=5)
        rows = [("a", "1", 0, "x", False), ("b", "2", 0, "whole", True), ("a", "1", 2, "z", False)]
        out = list(run((0,), iter([pd.DataFrame(rows, columns=cols)]), state))
        assert [tuple(r) for f in out for r in f.itertuples(index=False)] == first and state.wait == 1000
        state = Held(now=505, value=state.value)
        assert list(run((0,), iter([pd.DataFrame([("c", "3", 1, "y", False)], columns=cols)]), state)) == [] and state.wait == 500
        state = Held(now=1005, value=state.value, timed_out=True)
        out = list(run((0,), iter([]), state))
        assert [tuple(r) for f in out for r in f.itertuples(index=False)] == cut and state.wait == 500
        state = Held(now=1505, value=state.value, timed_out=True)
        assert len(list(run((0,), iter([]), state))) == 1 and state.value is None


def test_users_that_share_a_group_count_by_themselves():
    import pandas as pd

    run = ST._bucket_factory("user_id", ST._quota_factory(1), lambda user, counts: (), 1000)
    day = ST.DAY_MICROS
    cols = ["request_id", "no_id", "user_id", "at", "daily_limit", "edge_limit", "wants_edge"]
    rows = [(i, i == 7, f"u{i % 500}" if i else None, 3 * day + i, 2, 1, i % 2 == 0) for i in range(2000)]
    state = Held()
    out = pd.concat(run((0,), iter([pd.DataFrame(rows, columns=cols)]), state))
    assert len(out) == 2000 and out["request_id"].isna().sum() == 1 and out["user_id"].isna().sum() == 1
    got = {r.request_id: (r.rl_seq, r.rl_allowed) for r in out.dropna(subset=["request_id"]).itertuples()}
    assert got[0] == (1, True) and got[4] == (1, True) and got[504] == (2, True) and got[1004] == (3, False) and got[500] == (1, True)
    state = Held(now=10, value=state.value)
    out = pd.concat(run((0,), iter([pd.DataFrame([(1, False, "u4", day, 2, 1, True), (2, False, "u4", 3 * day, 2, 1, True)], columns=cols)]), state))
    assert out["late"].tolist() == [True, False] and out["rl_seq"].tolist()[1] == 5


def test_chunks_of_seven_characters(spark):
    from shroud.plans import catalog as C

    texts = ["", "a", "1234567", "12345678", "líneas\n😀😀 y más\r\n de 7", "😀" * 15]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.seven_characters("t").alias("c")).collect()
    assert {r.t: r.c for r in got} == {t: [t[i:i + 7] for i in range(0, max(len(t), 1), 7)] for t in texts}


def test_requests_without_a_time_count_as_a_day_of_their_own(spark, tmp_path):
    at = datetime(2024, 5, 1, 9)
    s = arriving(spark, tmp_path, "request_id long, ts timestamp, kp_user_id string, kp_tier string", [[(1, at, "u", "free"), (2, None, "u", "free"), (4, None, "v", "free"), (3, None, "u", "free"), (5, at, "v", "free")]])
    out = ST.run_to_table(ST.rate_limit_stream(s, {"free": 1}), "quota").collect()
    assert {r.request_id: (r.rl_seq, r.rl_allowed, r.late) for r in out} == {1: (1, True, False), 2: (1, True, False), 3: (2, False, False), 4: (1, True, False), 5: (1, True, False)}
