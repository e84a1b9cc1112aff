"""Detection report and the one-pass verdict: empty texts, unpaid tiers, a failed model."""
from shroud.operators import detect
from shroud.operators import mask as MK


def test_detect_report(spark):
    ents = "array<struct<type:string,value:string>>"
    rows = [(1, "Ana writes to ana@example.org", "pro", "found", [("PERSON", "Ana")]),
            (2, "Ana writes to ana@example.org", "free", "found", [("PERSON", "Ana")]),
            (3, "Ana is here", "pro", "error", [("PERSON", "Ana")]),
            (4, None, "enterprise", None, None), (5, "", None, "error", None)]
    df = spark.createDataFrame(rows, f"request_id long, text string, kp_tier string, ner_status string, ner_entities {ents}")
    got = {r.request_id: r for r in detect.detect_report(df).collect()}
    assert got[1].sanitized == "[PERSON_1] writes to [EMAIL_1]" and got[1].pii_type_counts == "EMAIL:1,PERSON:1"
    assert got[2].sanitized == "Ana writes to [EMAIL_1]" and not got[2].ner_ran and got[2].pii_count == 1
    assert got[3].ner_error and got[3].pii_count == 0 and got[3].sanitized == "Ana is here"
    assert got[4].pii_count == 0 and not got[4].ner_error and got[4].sanitized == ""
    assert not got[5].ner_ran and not got[5].ner_error and got[5].pii_types == ""
    assert detect.detect_report(df.where("request_id < 0")).count() == 0


def test_verdict_in_the_masking_pass(spark):
    df = spark.createDataFrame([(1, "a@example.org and b@example.org"), (2, "nothing"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.matches, r.types, r.masked) for r in MK.mask_texts(df, verdict=True).collect()}
    assert got == {1: (2, ["EMAIL"], "[EMAIL_1] and [EMAIL_2]"), 2: (0, [], "nothing"), 3: (0, [], "")}
