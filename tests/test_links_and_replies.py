"""Next links and the chains they make; long replies; numbers past the integers."""

import json

from pyspark.sql import functions as F

from newsloom.functions import content, text, url
from newsloom.operators.ingest import follow_next


def test_next_link(spark):
    cases = {
        '<a href="/2" rel="next">': "/2", "<LINK data-rel=x rel=NEXT href='/a?b=1&amp;c=2'>": "/a?b=1&c=2", '<a class="next" href=/3 rel=next>more</a>': "/3",
        '<a rel="prev" href="/1"><a rel="next" href="/5">': "/5", '<a rel="nextish" href="/x">': None, '<a rel="next">': None, '<a data-href="/no" rel="next" href="/yes">': "/yes", "": None, None: None,
    }
    rows = spark.createDataFrame([(h, w) for h, w in cases.items()], "html string, want string")
    assert [(r["html"], r["got"]) for r in rows.select("html", "want", url.next_link(F.col("html")).alias("got")).where("not (got <=> want)").collect()] == []


def test_chains(spark):
    starts = spark.createDataFrame([("a",), ("a",), ("x",), (None,), ("gone",), ("self",)], "url string")
    fetched = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "missing"), ("self", "self"), ("d", None)], "url string, next string").withColumns({"at": F.lit(1), "chain": F.lit(2), "start": F.lit(3)})
    got = follow_next(starts.withColumn("chain", F.lit("clash")), fetched).collect()
    assert sorted(map(tuple, got)) == [("a", 0, "a"), ("a", 1, "b"), ("a", 2, "c"), ("self", 0, "self"), ("x", 0, "x")]
    assert len(follow_next(starts, fetched, 2).where("start = 'a'").collect()) == 2
    assert follow_next(starts.limit(0), fetched).count() == follow_next(starts, fetched.limit(0)).count() == 0


def test_a_long_reply_is_read(spark):
    reply = json.dumps({"keywords": ["Ada", "x" * 200_000], "questions": ["What is " + "it " * 30_000, "Who is it?"]})
    row = spark.createDataFrame([(f"Here:\n```json\n{reply}\n```",)], "t string").select(content.chunk_keywords(F.col("t")).alias("k")).first()["k"]
    assert (row["keywords"], row["questions"]) == (["ada"], ["Who is it?"])


def test_numbers_past_the_integers(spark):
    row = spark.createDataFrame([("[#99999999999] [#3] [5-99999999999] [#7, 8]",)], "t string").select(text.cited_numbers(F.col("t")).alias("a"), text.citation_ids(F.col("t")).alias("b")).first()
    assert (row["a"], row["b"]) == ([3, 5, 7, 8], [3])
