"""Claims under races and replays; the data source and the sink."""

import os
import tempfile
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from newsloom.operators.claims import Ledger
from newsloom.sources import folders, web
from newsloom.streaming import timed


def tmp():
    return tempfile.mkdtemp(prefix="spark-ledger-", dir="/tmp")


def test_racing_workers_share_nothing(spark):
    d, queue = f"file://{tmp()}", spark.range(40).withColumnRenamed("id", "key")
    Ledger(spark, d)
    work = lambda w: [r["key"] for r in Ledger(spark, d).claim(queue, "key", ["key"], 8, f"w{w}", f"b{w}", 0, 60).collect()]
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(work, range(4)))
    assert sorted(k for g in got for k in g) == list(range(32)) and all(len(g) == 8 for g in got)
    assert [c["number"] for c in Ledger(spark, d).commits()] == [0, 1, 2, 3]
    # a batch that is run again claims what it claimed
    assert work(2) == got[2] and len(Ledger(spark, d).commits()) == 4


def test_leases_end_and_finished_items_stay(spark):
    ledger, queue = Ledger(spark, f"file://{tmp()}"), spark.range(3).withColumnRenamed("id", "key")
    keys = lambda df: sorted(r["key"] for r in df.collect())
    claim = lambda w, b, now: keys(ledger.claim(queue, "key", ["key"], 2, w, b, now, 10))
    assert claim("a", "1", 0) == [0, 1] and claim("b", "2", 5) == [2] and claim("b", "3", 5) == []
    ledger.finish(spark.createDataFrame([(0,)], "key long"), "key", "a", "4")
    assert claim("c", "5", 11) == [1]
    ledger.finish(spark.createDataFrame([(1,), (7,)], "key long"), "key", "a", "6")  # too late, and never claimed
    assert keys(ledger.rows().where("action = 'finish'")) == [0]
    assert claim("d", "7", 100) == [1, 2]
    assert keys(ledger.claim(queue.limit(0), "key", ["key"], 2, "e", "8", 200, 1)) == []


FEED = "<rss><channel><item><title>T{0}</title><link>http://a/{0}</link><pubDate>2024-01-0{0}</pubDate></item><item><title>no link</title></item></channel></rss>"


def test_feed_folder_as_table_and_stream(spark):
    folders.register(spark)
    d, out = tmp(), tmp()
    texts = [("a1.xml", FEED.format(1)), ("a2.xml", "<urlset><url><loc>http://p</loc></url></urlset>"), ("a3.xml", "<rss><chan"), ("a4.xml", None), ("x.txt", FEED.format(9)), ("a5.xml", "<!DOCTYPE x [<!ENTITY e 'x'>]>" + FEED.format(5))]
    folders.save_texts(spark.createDataFrame(texts, "name string, text string"), f"file://{d}")
    read = lambda df: sorted((r["file"], r["place"], r["kind"], r["title"], r["link"]) for r in df.collect())
    want = [("a1.xml", 0, "feed", "T1", "http://a/1"), ("a2.xml", 0, "page", None, "http://p")]
    assert read(spark.read.format("newsloom_feeds").load(f"file://{d}")) == want
    assert spark.read.format("newsloom_feeds").load(f"file://{tmp()}/none").count() == 0
    stream = lambda: timed.run_to_table(spark.readStream.format("newsloom_feeds").load(f"file://{d}"), f"file://{out}")
    assert read(stream()) == want
    folders.save_texts(spark.createDataFrame([("b1.xml", FEED.format(2))], "name string, text string"), f"file://{d}")
    assert read(stream()) == [*want, ("b1.xml", 0, "feed", "T2", "http://a/2")]
    assert len(os.listdir(f"{out}/rows")) == 2  # the second run read the new file alone


def test_large_sitemaps_and_long_feeds():
    entry, item = "<url><loc>http://a/b</loc></url>", "<item><title>T</title><link>http://a</link></item>"
    assert len(web.sitemap_entries("<urlset>" + entry * 10 + "</urlset>")) == 10
    assert web.sitemap_entries("<urlset>" + entry + " " * 25_000_000 + "</urlset>") == []
    assert len(web.feed_items("<rss>" + item + " " * 25_000_000 + item + "</rss>")) == 2
    assert web.feed_items("<!-- x -->" + " " * 5000 + "<!DOCTYPE rss><rss>" + item + "</rss>") == []


def test_samples_are_committed_whole_or_not_at_all(spark):
    folders.register(spark)
    d = tmp()
    rows = spark.range(0, 20, 1, 4).select(F.col("id"), F.when(F.col("id") % 5 == 0, "test").when(F.col("id") != 3, "train").alias("split"), F.lit('é "x"\n').alias("output"))
    save = lambda df, mode="append": df.write.format("newsloom_samples").mode(mode).save(f"file://{d}")
    back = lambda: sorted((r["id"], r["split"], r["output"]) for r in spark.read.schema("id long, split string, output string").json(f"file://{d}").collect())
    save(rows)
    first = back()
    assert len(first) == 20 and {r[1] for r in first} == {"test", "train", "none"} and first[0][2] == 'é "x"\n'
    broken = rows.withColumn("output", F.when(F.col("id") == 17, F.raise_error(F.lit("broken"))).otherwise("y"))
    with pytest.raises(Exception, match="broken"):
        save(broken)
    assert back() == first and not [x for x in os.listdir(d) if x.startswith("_aside")]
    save(rows.where("id < 2"), "overwrite")
    assert [r[0] for r in back()] == [0, 1]
