"""Source, sink and queue queries (SC*, H*)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from newsloom.catalog import scratch, table
from newsloom.functions import url as u
from newsloom.operators import claims
from newsloom.operators import ingest as op
from newsloom.sources import folders, images, web
from newsloom.streaming import timed

from .registry import query
from .text import TITLE


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 0 AND (s_suppkey % 5 = 0 OR TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MINUTE * (s_suppkey % 120) + INTERVAL 60 MINUTE <= TIMESTAMP '2024-01-01 02:00:00')")
def sc8_due_sources(spark, sf_dir):
    k = F.col("s_suppkey")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(mins=(k % 120).cast("int"))
    s = table(spark, sf_dir, "supplier").withColumns({"active": F.col("s_acctbal") > 0, "last_crawled": F.when(k % 5 != 0, at), "interval_minutes": F.lit(60)})
    return op.due(s, "2024-01-01 02:00:00").select("s_suppkey", "s_acctbal")


@query("""WITH old AS (SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'admin' ELSE 'seed' END AS source FROM supplier), new AS (SELECT s_suppkey + 5 AS id, 'new ' || s_name AS name, 'wikidata' AS source FROM supplier)
    SELECT id, coalesce(CASE WHEN o.source = 'admin' THEN o.name END, n.name, o.name) AS name, CASE WHEN o.source = 'admin' OR n.id IS NULL THEN o.source ELSE n.source END AS source FROM old o FULL JOIN new n USING (id)""")
def sc9_upsert(spark, sf_dir):
    k, s = F.col("s_suppkey"), table(spark, sf_dir, "supplier")
    old = s.select(k.alias("id"), F.col("s_name").alias("name"), F.when(k % 3 == 0, "admin").otherwise("seed").alias("source"))
    return op.upsert(old, s.select((k + 5).alias("id"), F.concat(F.lit("new "), "s_name").alias("name"), F.lit("wikidata").alias("source")), ["id"], F.col("source") == "admin")


@query("""SELECT event_id, user_id, value > 99 AS severe, EXISTS (SELECT 1 FROM events g WHERE g.user_id = e.user_id AND g.value <= 90) AS resolved FROM events e WHERE value > 90""")
def sc10_dead_letters(spark, sf_dir):
    good, dead = op.failures(table(spark, sf_dir, "events"), F.col("value") <= 90, F.col("value") > 99)
    return op.resolve_siblings(dead, good, "user_id").select("event_id", "user_id", (F.col("severity") == "critical").alias("severe"), "resolved")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) ORDER BY o_orderdate, o_orderkey LIMIT 25")
def sc12_claim(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return op.claim(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), done, "o_orderkey", ["o_orderdate", "o_orderkey"], 25)


@query("""WITH s(a) AS (VALUES ('discovered'), ('fetched'), ('failed'), ('quarantine'), ('cleaned'), ('discarded')) SELECT x.a AS before, y.a AS after,
      (x.a || '>' || y.a) IN ('discovered>fetched', 'discovered>failed', 'discovered>discarded', 'fetched>cleaned', 'fetched>failed', 'fetched>quarantine', 'fetched>discarded', 'failed>discovered', 'failed>discarded', 'quarantine>discovered', 'quarantine>fetched', 'quarantine>discarded', 'cleaned>discarded') AS legal FROM s x, s y""")
def state_transitions(spark, sf_dir):
    s = spark.createDataFrame([(a, b) for a in op.TRANSITIONS for b in op.TRANSITIONS], "before string, after string")
    return s.select("before", "after", op.legal(F.col("before"), F.col("after")).alias("legal"))


@query()
def h1_extract_pages(spark, sf_dir):
    """H1, H2, H5, H6: tiers, title, text and image of every page."""
    return table(spark, sf_dir, "pages").select("page_id", web.extract_page(F.col("html"), F.col("url")).alias("x")).select("page_id", "x.*")


@query()
def sc4_listing_links(spark, sf_dir):
    return web.listing_cards(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query("SELECT page_id, i AS item, 'Item ' || i AS title, url || '/' || i AS link FROM pages CROSS JOIN range(1, 3) r(i)")
def sc2_feed_items(spark, sf_dir):
    """A feed made of each page's URL, parsed back."""
    one = lambda i: F.concat(F.lit(f"<item><title>Item {i}</title><link>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit(f"/{i}</link></item>"))
    xml = F.concat(F.lit("<rss><channel>"), one(1), one(2), F.lit("<item><title>no link</title></item></channel></rss>"))
    p = table(spark, sf_dir, "pages").select("page_id", F.posexplode(web.parse_feed(xml)).alias("i", "x"))
    return p.select("page_id", (F.col("i") + 1).cast("long").alias("item"), "x.title", "x.link")


@query("SELECT page_id, url AS loc, 1704067200 AS lastmod FROM pages")
def sc3_sitemap(spark, sf_dir):
    xml = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>'), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc><lastmod>2024-01-01</lastmod></url><url><loc/></url></urlset>"))
    p = table(spark, sf_dir, "pages").select("page_id", F.inline(web.parse_sitemap(xml)))
    return p.select("page_id", "loc", F.unix_seconds("lastmod").cast("int").alias("lastmod"))


@query(f"""WITH RECURSIVE p AS (SELECT url, min(page_id) AS id FROM pages WHERE url IS NOT NULL GROUP BY 1),
    l AS (SELECT p.url, CASE p.id % 7 WHEN 0 THEN NULL WHEN 1 THEN regexp_extract(p.url, '^https?://[^/?#]*') || '/en/none' ELSE o.url END AS next FROM p LEFT JOIN pages o ON o.page_id = CASE WHEN p.id % 7 = 2 THEN p.id - 1 WHEN p.id % 11 = 3 THEN p.id - 2 ELSE p.id + 1 END),
    c AS (SELECT url AS start, 0 AS place, url, [url] AS seen FROM p
      UNION ALL SELECT start, place + 1, l.next, list_append(seen, l.next) FROM c JOIN l ON l.url = c.url JOIN p ON p.url = l.next WHERE place < 4 AND NOT list_contains(seen, l.next))
    SELECT start, place, url FROM c""")
def sc5_followed_pages(spark, sf_dir):
    """Five pages from every page on, by next links to a neighbour of each, to pages that aren't there, and in circles; written in several ways."""
    p = table(spark, sf_dir, "pages").where("url is not null")
    first, k = p.groupBy("url").agg(F.min_by("html", "page_id").alias("html"), F.min("page_id").alias("page_id")), F.col("page_id")
    other = p.select(F.col("page_id").alias("to"), F.replace("url", F.lit("&"), F.lit("&amp;")).alias("href"))
    to = F.when(k % 7 == 0, None).when(k % 7 == 2, k - 1).when(k % 11 == 3, k - 2).otherwise(k + 1)
    linked = first.withColumn("to", to).join(other, "to", "left").withColumn("href", F.when(k % 7 == 1, "/en/none").otherwise(F.col("href")))
    tag = F.when(k % 3 == 0, F.format_string('<a class="p" rel="next" href="%s">', "href")).when(k % 3 == 1, F.format_string("<LINK href='%s' data-x=1 REL=next>", "href")).otherwise(F.format_string('<a rel="prev" href="/x"><a href="%s" rel="next">', "href"))
    html = F.when(F.col("href").isNull(), F.col("html")).otherwise(F.concat("html", tag))
    return op.follow_next(first.select("url"), linked.select("url", images.absolute(u.next_link(html), F.col("url")).alias("next")))


FILE_SQL = "printf('%08d.xml', page_id // 50)"


def _in_files(spark, sf_dir, item, head: str, tail: str) -> str:
    """A folder of XML files made from the pages, fifty items each."""
    folder = f"{scratch(spark)}/fetched-{uuid.uuid4().hex}"
    p = table(spark, sf_dir, "pages").select(F.format_string("%08d.xml", F.floor(F.col("page_id") / 50)).alias("name"), F.struct("page_id", item.alias("item")).alias("x"))
    texts = p.groupBy("name").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    folders.save_texts(texts.select("name", F.concat(F.lit(head), F.array_join(F.transform("xs", lambda x: x["item"]), ""), F.lit(tail)).alias("text")), folder)
    folders.register(spark)
    return folder


def _escaped(c) -> F.Column:
    return F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


@query(f"""WITH p AS (SELECT page_id, {FILE_SQL} AS file, trim(regexp_extract(html, '{TITLE}', 1)) AS title, url AS link FROM pages WHERE url IS NOT NULL)
    SELECT file, (row_number() OVER (PARTITION BY file ORDER BY page_id) - 1)::INTEGER AS place, title, link FROM p WHERE title <> ''""")
def sc2_feed_folder(spark, sf_dir):
    """Feeds made from the pages' titles and addresses, read through the data source."""
    item = F.concat(F.lit("<item><title>"), _escaped(F.regexp_extract("html", TITLE, 1)), F.lit("</title><link>"), _escaped(F.col("url")), F.lit("</link></item>"))
    folder = _in_files(spark, sf_dir, item, "<rss><channel>", "</channel></rss>")
    return spark.read.format("newsloom_feeds").load(folder).where("kind = 'feed'").select("file", "place", "title", "link")


@query(f"""SELECT {FILE_SQL} AS file, (row_number() OVER (PARTITION BY page_id // 50 ORDER BY page_id) - 1)::INTEGER AS place, url AS link, (1704067200 + page_id * 86400)::BIGINT AS at FROM pages WHERE url IS NOT NULL""")
def sc3_sitemap_stream(spark, sf_dir):
    """Sitemaps made from the pages' addresses, read as a stream; a page's number is its day."""
    day = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 86400), "yyyy-MM-dd")
    item = F.concat(F.lit("<url><loc>"), _escaped(F.col("url")), F.lit("</loc><lastmod>"), day, F.lit("</lastmod></url>"))
    folder = _in_files(spark, sf_dir, item, '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">', "</urlset>")
    rows = timed.once(spark, lambda: spark.readStream.format("newsloom_feeds").load(folder))
    return rows.where("kind = 'page'").select("file", "place", "link", F.unix_seconds("at").alias("at"))


LEASES_SQL = """q AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS i FROM orders),
    first AS (SELECT o_orderkey, i, CASE WHEN i <= 40 THEN 'ada' ELSE 'ben' END AS worker FROM q WHERE i <= 70), left_over AS (SELECT o_orderkey, i FROM q WHERE i <= 40 AND o_orderkey % 2 = 1 OR i > 70)"""


@query(f"""WITH {LEASES_SQL} SELECT o_orderkey, worker, CASE worker WHEN 'ada' THEN 100 ELSE 120 END::BIGINT AS until FROM first
    UNION ALL SELECT o_orderkey, 'cem', 250 FROM (SELECT * FROM left_over ORDER BY i LIMIT 50)""")
def sc12_leases(spark, sf_dir):
    """Orders as a queue: one worker claims 40 and finishes the even ones, another claims 30; when the first one's lease has run out, before
    the second one's, a third claims 50. Each batch is run twice."""
    ledger = claims.Ledger(spark, f"{scratch(spark)}/ledger-{uuid.uuid4().hex}")
    orders, key = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey"
    ask = lambda most, worker, batch, now, lease: ledger.claim(orders, key, ["o_orderdate", key], most, worker, batch, now, lease)
    for _ in range(2):
        a = ask(40, "ada", "a1", 0, 100)
        b = ask(30, "ben", "b1", 20, 100)
        ledger.finish(a.where(F.col(key) % 2 == 0), key, "ada", "a1 done")
        c = ask(50, "cem", "c1", 110, 140)
    return a.unionByName(b).unionByName(c).select(key, "worker", "until")


@query(r"SELECT page_id, NOT starts_with(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/de/') AS allowed FROM pages")
def sc7_robots(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", web.allowed(F.lit("User-agent: *\nDisallow: /de/\n"), F.lit("bot"), F.col("url")).alias("allowed"))


HOST_SQL = "regexp_extract(url, '^https?://[^/?#]*')"


@query(f"""SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS position, CASE i WHEN 1 THEN {HOST_SQL} || '/img/' || page_id || '.jpg' ELSE regexp_extract(url, '^https?:') || '//cdn.example.com/' || page_id || '.png' END AS image_url,
      CASE i WHEN 1 THEN 'one' ELSE 'two' END AS alt, CASE i WHEN 1 THEN 'first' ELSE 'by hand' END AS caption FROM pages CROSS JOIN range(1, 3) r(i) WHERE i = 2 OR NOT regexp_matches(url, '^https?://([^/?#]*[-_])?(ads?|banner)([-_/.0-9]|$)')""")
def h8_body_images(spark, sf_dir):
    """An article with two images among decoration, set before each page; a host named like an advertiser's makes the first one decoration too."""
    n = F.col("page_id").cast("string")
    parts = (
        '<header><img src="/top.jpg"></header><article class="body"><figure><img src="/img/', n, '.jpg" width="800px" height="600" alt="one"><figcaption>first</figcaption></figure><img src="/logo/a.png"><img src="/s.jpg" width="50">',
        '<figure><img src="spacer.gif" data-srcset="//cdn.example.com/', n, '.png 1x, b.png 2x" alt="two"><p>two - by hand</p></figure><ul><li><img src="/more.jpg"></li></ul><div class="related-news"><img src="/r.jpg"></div>',
        '<img src="/img/', n, '.jpg"><img src="/strip.jpg" width="2000" height="300"><img src="/v.svg"><img src="/x.jpg" alt="Paylaş"></article>', F.coalesce("html", F.lit("")),
    )
    html = F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    return images.page_images(table(spark, sf_dir, "pages").select("page_id", "url", html.alias("html")))


@query(rf"""WITH s AS (SELECT page_id, coalesce(url, '') AS url, regexp_extract_all(html, 'href="(/[^"/?#;&]*)"', 1) AS a FROM pages), i AS (SELECT *, unnest(range(len(a))) AS place FROM s),
    x AS (SELECT page_id, url, place, CASE place % 4 WHEN 0 THEN 'https://a.example' WHEN 1 THEN '//cdn.example.com' WHEN 2 THEN '' ELSE '/' END || a[place + 1] AS src FROM i)
    SELECT page_id, place, CASE WHEN starts_with(src, '//') THEN coalesce(nullif(regexp_extract(url, '^[a-z]+:'), ''), 'https:') || src WHEN starts_with(src, '/') THEN {HOST_SQL} || src ELSE src END AS image_url FROM x""")
def x6_image_urls(spark, sf_dir):
    """The addresses that pages refer to, whole, without scheme, and from the root."""
    found = F.regexp_extract_all("html", F.lit('href="(/[^"/?#;&]*)"'), F.lit(1))
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(found).alias("place", "path"))
    k = F.col("place") % 4
    src = F.concat(F.when(k == 0, "https://a.example").when(k == 1, "//cdn.example.com").when(k == 2, "").otherwise("/"), "path")
    return p.select("page_id", F.col("place").cast("long").alias("place"), images.absolute(src, F.col("url")).alias("image_url"))