"""Spark evaluation vs a brute-force Python re-computation on a small fixture."""
from collections import Counter

from pyspark.sql import functions as F

from shroud.functions import kernel as K
from fixtures import SF_SMALL
from shroud.sources.tables import table
from shroud.operators import corpus, evaluate


def test_recall_and_fp_against_brute_force(spark):
    c = corpus.generate(table(spark, SF_SMALL, "customer", "c_custkey"), "c_custkey")
    m = evaluate.masked_cases(c)
    scored = evaluate.score_entities(m)
    got = {r.type: (r.expected, r.found) for r in evaluate.recall_by_type(scored).collect()}
    got_fp = {r.type: r.fp for r in evaluate.fp_by_type(evaluate.false_positives(m)).collect()}

    exp, found, fp = Counter(), Counter(), Counter()
    for row in c.collect():
        _, toks = K.mask_text(row.text)
        vals = [v for _, _, v in toks]
        ents = row.entities
        for e in ents:
            if e.ner_scope:
                continue
            exp[e.type] += 1
            found[e.type] += e.value in vals
        allv = [e.value for e in ents]
        for t, _, v in toks:
            if v in allv or any(v in g and len(v) < len(g) for g in allv):
                continue
            fp[t] += 1
    assert got == {t: (exp[t], found[t]) for t in exp}
    assert got_fp == dict(fp)


def test_ner_summary_latency_index_rule(spark):
    rows = [(f"c{i}", "m", "ok", lat, [], [], []) for i, lat in enumerate([5, 1, 9, 3, 7, 7, 2])]
    rows.append(("cx", "m", "error", 100, [], [], []))
    schema = ("case_id string, model string, status string, latency_ms int, found array<struct<type:string,value:string>>,"
              " missed array<struct<type:string,value:string>>, false_pos array<struct<type:string,value:string>>")
    ns = spark.createDataFrame(rows, schema).withColumn("expected_n", F.lit(0)).withColumn("returned_n", F.lit(0)) \
        .withColumn("verbatim_n", F.lit(0)).withColumn("paraphrased_n", F.lit(0))
    r = evaluate.ner_summary(ns).collect()[0]
    lat = sorted([5, 1, 9, 3, 7, 7, 2])
    assert r.p50_ms == lat[min(6, int(7 * 0.5))] and r.p95_ms == lat[min(6, int(7 * 0.95))]
    assert r.avg_latency_ms == round(sum(lat) / 7) and r.errors == 1


def test_combined_recall_rule(spark):
    reg = spark.createDataFrame([(40, 50)], "found long, expected long")
    ner_ = spark.createDataFrame([(9, 10)], "found long, expected long")
    same = spark.createDataFrame([(50,)], "n long")
    other = spark.createDataFrame([(51,)], "n long")
    r = evaluate.combined_recall(reg, ner_, same).collect()[0]
    assert (r.combined_found, r.combined_expected, r.combined_pct, r.skip_reason) == (49, 60, 81.7, None)
    r = evaluate.combined_recall(reg, ner_, other).collect()[0]
    assert r.combined_found is None and "51" in r.skip_reason


def test_values_at_ranks_equal_a_sort(spark):
    import random

    r = random.Random(8)
    for high in (3, 5000, 10 ** 12):
        rows = [(r.randrange(-high, high), r.randrange(4)) for _ in range(300)]
        df = spark.createDataFrame(rows, "v long, c long")
        every = sorted(v for v, c in rows for _ in range(c))
        ranks = [0, 1, len(every) // 2, len(every) - 1]
        assert evaluate.values_at(df, "v", "c", ranks) == [every[k] for k in ranks]
    assert evaluate.values_at(df.where("c < 0"), "v", "c", [0]) == [None]


def test_hand_written_categories(spark):
    """Each category has cases; ambiguous ones give false positives, values said to be out of reach are found."""
    c = corpus.generate(spark.range(10_000, 10_100).withColumnRenamed("id", "k"), "k").cache()
    cases = {r.category: r.n for r in c.groupBy("category").agg(F.count("*").alias("n")).collect()}
    assert {k: cases[k] for k in ("negative", "indirect-reference", "ambiguous", "hard-name")} == dict.fromkeys(("negative", "indirect-reference", "ambiguous", "hard-name"), 2)
    assert cases["malformed-format"] == 12
    masked = evaluate.masked_cases(c)
    fps = {(r.category, r.type) for r in evaluate.false_positives(masked).collect()}
    assert fps == {("ambiguous", "PASSPORT"), ("ambiguous", "DATE")}
    gaps = [r.type for r in evaluate.gap_mismatches(evaluate.score_entities(masked)).collect()]
    assert sorted(gaps) == ["LAWYER_ID_UNCOVERED"] * 2 + ["NHC_UNCOVERED"] * 2
    names = c.where("category = 'hard-name'").selectExpr("text", "inline(entities)").collect()
    assert len(names) == 4 and all(r.ner_scope and r.text[r.start:r.end] == r.value for r in names)
    assert c.where("category IN ('negative', 'indirect-reference', 'ambiguous') AND size(entities) > 0").isEmpty()
