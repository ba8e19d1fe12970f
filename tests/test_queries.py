"""Query functions on small literal rows."""

import pytest
from pyspark.sql import functions as F

from newsloom.functions import query as q
from newsloom.operators import entities, retrieval

from .test_kernels import many, one


def test_questions_and_bypass(spark):
    assert many(spark, ["Kim kazandı", "deprem", "ne zaman olacak", "saat 5?"], "string", q.is_question) == [True, False, True, True]
    assert many(spark, ["Galatasaray maç", "kim kazandı şimdi", "a b c d e", "izmir çevre yolu", ""], "string", q.planner_bypass) == [["galatasaray"], None, None, ["izmir", "çevre"], None]


def test_standalone(spark):
    cases = {"bu hafta ne oldu acaba": True, "bu iddia doğru mu": False, "Özgür Özel bu iddiayı": False, "peki Ankara": False, "Trump'ın açıklaması": True, "ekonomi": False, "2024 bütçe": True, "": False}
    assert many(spark, list(cases), "string", q.is_standalone) == list(cases.values())


def test_decompose(spark):
    assert many(spark, ["enflasyon verileri ve asgari ücret", "Ahmet ve Mehmet", "tek konu"], "string", q.decompose) == [["enflasyon verileri", "asgari ücret"], [], []]


def test_candidates_and_phrases(spark):
    assert one(spark, q.entity_candidates(F.lit("Tutak'ın İHA Bayraktar F-16 bayraktar"), 3)) == ["tutak", "iha", "bayraktar", "f-16"]
    assert one(spark, q.phrases(F.lit("izmir yolu mi olacak"))) == ["izmir yolu", "yolu mi", "izmir yolu mi", "yolu mi olacak", "izmir yolu mi olacak"]


def test_names(spark):
    assert many(spark, ["Bugün", "BUGÜN", "açıklama", "Ankara", None], "string", q.is_noise) == [True, True, True, False, False]
    assert many(spark, ["maçı", "maç raporu", "süper lig", "lig"], "string", q.is_generic) == [True, True, False, True]
    e = many(spark, ["2026 Avrupa Tekvando Şampiyonası", "49. G7 zirvesi", "2. Lig", "Dünya Kupası"], "string", q.event_edition)
    assert [(x["base"], x["edition"]) for x in e] == [("Avrupa Tekvando Şampiyonası", "2026"), ("G7 zirvesi", "49."), ("2. Lig", None), ("Dünya Kupası", None)]
    fits = spark.createDataFrame([("person", ["Q5"]), ("person", []), ("org", ["Q5"]), ("place", None), ("event", ["Q573"])], "t string, c array<string>")
    assert [r[0] for r in fits.select(q.type_fits(F.col("t"), F.col("c"))).collect()] == [True, False, False, True, False]
    assert one(spark, entities.strip_titles(F.lit("sayin prof. ada"), ("sayin", "prof"))) == "ada"


def test_since_hours(spark):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    assert one(spark, q.since_hours(F.lit("2024-01-01 12:30:00").cast("timestamp"), now, 72)) == 12
    assert one(spark, q.since_hours(F.lit(None).cast("timestamp"), now, 72)) == 72
    assert one(spark, q.since_hours(F.lit("2023-01-01").cast("timestamp"), now, 72)) == 72
    assert one(spark, q.since_hours(now, now, 72)) == 6


def test_critical_filter_falls_back(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 1)], "query_id int, id int, rank int")
    asked = spark.createDataFrame([(1, "x"), (2, "y")], "query_id int, entity string")
    named = spark.createDataFrame([("x", 11)], "entity string, article_id int")
    assert sorted((r["query_id"], r["id"]) for r in retrieval.keep_critical(ranked, asked, named).collect()) == [(1, 11), (2, 12)]


@pytest.mark.parametrize(("tf", "total"), [(1, 0.1), (2, 0.125)])
def test_term_rank(spark, tf, total):
    assert one(spark, retrieval.term_rank(F.lit(tf))) == pytest.approx(total / 1.64493406685)


def test_extraction_deals_out_names_without_texts(spark):
    from newsloom.operators import entities

    reply = '[{"text":"Ada","type":"PERSON"},{"text":"ada ","type":"person"},{"text":"Ada","type":"city"},{"text":"x","type":"org"}]'
    raw = spark.createDataFrame([(1, "On Ada", "paper", "ada and Ada", reply), (2, None, None, "no name", None)], "article_id long, title string, subtitle string, body string, json string")
    e = entities.from_extraction(raw)
    assert sorted(tuple(r) for r in e.collect()) == [(1, "Ada", "ada", "misc", "title", 3), (1, "Ada", "ada", "person", "title", 3)]
    plan = e._jdf.queryExecution().executedPlan().toString()
    dealt = plan[plan.index("Window ") : plan.index("Generate ")]
    assert "Exchange" in dealt and "whole" not in dealt and "body" not in dealt


def test_coverage_leaves_out_only_the_querys_own_row(spark):
    asked = spark.createDataFrame([(1, "a", "red"), (1, "a", "Ring "), (2, "a", "red"), (3, "b", "red"), (3, "b", "")], "query_id long, `group` string, entity string")
    chunks = spark.createDataFrame([(1, "a", "a RED ring"), (2, "a", "infrared"), (3, "b", "red"), (4, "b", None)], "id long, `group` string, text string")
    assert sorted(tuple(r) for r in retrieval.entity_coverage(asked, chunks).collect()) == [(1, 0.5), (2, 1.0), (3, 0.0)]


def test_affinity_meets_only_ranked_rows(spark):
    """A liked entity named by many articles, of which one is ranked."""
    ranked = spark.createDataFrame([(1, 5, 0.50, 1), (1, 7, 0.49, 2), (2, 7, 0.4, 1)], "query_id int, id long, score double, rank int")
    liked = spark.createDataFrame([(1, "x"), (1, "x")], "query_id int, entity string")
    m = spark.range(6, 3000).select(F.lit("x").alias("entity"), F.col("id").alias("article_id"))
    got = retrieval.affinity_boost(ranked, liked, m)
    assert sorted((r["query_id"], r["id"], round(r["score"], 2), r["rank"]) for r in got.collect()) == [(1, 5, 0.5, 2), (1, 7, 0.54, 1), (2, 7, 0.4, 1)]
    assert retrieval._naming(ranked, liked, m).count() == 1


def test_entity_stream_equals_the_plain_one(spark):
    """Rare and common entities, queries of one to four, an entity that no article names, a question asked often; and no query meets all articles of a common entity."""
    import random

    rng = random.Random(5)
    mentions = {(f"c{k}", a) for k in range(6) for a in range(400) if rng.random() < 0.35} | {(f"r{k}", a) for k in range(5) for a in rng.sample(range(400), 8)} | {("r0", 7), ("r1", 7)}
    wanted = {q: set(rng.sample([*(f"c{k}" for k in range(6)), *(f"r{k}" for k in range(5)), "none"], rng.randint(1, 4))) for q in range(60)}
    wanted |= {100 + q: {"c0", "c1", "c2"} for q in range(5)} | {200: {"c0", "c1", "c2", "c3"}, 201: {"c1", "c3"}, 202: {"r0", "r1", "c0"}}
    want = set()
    for q, names in wanted.items():
        on = {e: {a for x, a in mentions if x == e} for e in names}
        on = {e: a for e, a in on.items() if a}
        rare = [e for e in sorted(on, key=lambda e: (len(on[e]), e)) if len(on[e]) < 30]
        if len(rare) >= 2:
            every = set.intersection(*(on[e] for e in rare))
            want |= {(q, "multi_and", a) for a in every} or {(q, "single_rare", a) for a in on[rare[0]]}
        elif rare:
            want |= {(q, "single_rare", a) for a in on[rare[0]]}
        elif len(on) >= 2:
            every = set.intersection(*on.values())
            want |= {(q, "multi_and_common", a) for a in every} if len(every) < 30 else set()
    asked = spark.createDataFrame([(q, e) for q, names in wanted.items() for e in names], "query_id int, entity string")
    df = spark.createDataFrame([*mentions, *list(mentions)[:50]], "entity string, article_id long")
    got = [tuple(r) for r in retrieval.ner_targets(asked, df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {m for _, m, _ in want} == {"multi_and", "single_rare", "multi_and_common"}
    sets = spark.createDataFrame([(["c0", "c1"],)], "entities array<string>")
    assert retrieval._together(sets, df.distinct(), 1000).count() == len({a for e, a in mentions if e == "c0"} & {a for e, a in mentions if e == "c1"})


def test_an_event_late_in_a_day_counts_on_that_day(spark, tmp_path):
    from newsloom import plans

    spark.sql("SELECT 1L AS event_id, TIMESTAMP_NTZ '2024-01-01 23:59:59.7' AS ts, 1L AS user_id").write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in plans.QUERIES["tr16_daily_backfill"](spark, str(tmp_path)).collect()] == [(1704067200, 1)]


def test_coverage_asks_for_every_part(spark, tmp_path):
    """Parts whose keys are no multiples of 20 are asked for as well."""
    from newsloom import plans

    from .oracle import differences

    rows = [(1, "red ring", "A", "BIG"), (2, "red bolt", "A", "SMALL"), (19, "Plate big", "A", "x"), (20, "red red", "B", "x"), (21, "ring", "B", "wired"), (40, " ", "B", "x"), (41, "lone", "C", "lone")]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    got = plans.QUERIES["r21_entity_coverage"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0.5), (2, 0.5), (19, 0.5), (20, 1.0), (21, 0.0), (41, 0.0)]
    assert differences(got, str(tmp_path), plans.ORACLE_SQL["r21_entity_coverage"]) == []


@pytest.mark.parametrize(("pairs", "size", "batch"), [(20_000, 4 << 20, 1000), (7, 60, 1000), (7, 60, 0)])
def test_ends_of_groups_equal_contains(spark, monkeypatch, pairs, size, batch):
    """One bucket and many; a group of many words and texts is cut into parts and slices; words of one group stand in texts of another; groups without words or texts; nulls."""
    import random

    from newsloom.operators import patterns

    monkeypatch.setattr(patterns, "AUTOMATON", pairs)
    monkeypatch.setattr(patterns, "SLICE_BYTES", size)
    monkeypatch.setattr(patterns, "BATCH", batch)
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abç ") for _ in range(n))
    group = lambda: "hot" if rng.random() < 0.5 else f"g{rng.randrange(12)}"
    texts = [(group(), word(rng.randint(0, 12)), i, i + rng.randrange(5)) for i in range(300)] + [("texts only", "abc", 1, 2), (None, "ab", 1, 1), ("hot", None, 1, 999), ("hot", "a", None, None)]
    wanted = [(group(), word(rng.randint(1, 4))) for _ in range(200)] + [("words only", "a"), (None, "a"), ("hot", ""), ("hot", None), ("hot", "a")]
    pairs = spark.createDataFrame(list(set(wanted)), "`group` string, pattern string")
    got = patterns.ends(spark.createDataFrame(texts, "`group` string, text string, least long, most long"), pairs, pairs.count())
    want = {}
    for g, p in set(wanted):
        on = [(a, b) for x, t, a, b in texts if g and p and x == g and t and p in t and a is not None]
        if on:
            want[g, p] = (min(a for a, _ in on), max(b for _, b in on))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and {r[:2]: r[2:] for r in rows} == want
