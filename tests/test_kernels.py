"""Column kernels on small literal rows."""

import math
import statistics

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsloom.config import DEFAULT
from newsloom.functions import pii, trend
from newsloom.functions import text as t
from newsloom.functions import url as u
from newsloom.functions import vector as v
from newsloom.sources import web


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def many(spark, values, ddl, f):
    return [r[0] for r in spark.createDataFrame([(x,) for x in values], f"c {ddl}").select(f(F.col("c"))).collect()]


def test_urls(spark):
    cases = {
        "https://Example.COM/Path?utm_source=x&id=1#frag": "https://example.com/Path?id=1",
        "http://a.b:80//x///y?b=2&a=1&ref=z&e=": "http://a.b/x/y?a=1&b=2",
        "https://a.b:443": "https://a.b/",
        "http://a.b/x?UTM_Source=1": "http://a.b/x",
        "": "",
    }
    assert many(spark, cases, "string", u.canonical) == list(cases.values())
    assert many(spark, ["http://a/haber/5983252/x", "http://a/x-944072.html", "http://a/12345"], "string", u.external_id) == ["5983252", "944072", None]
    assert many(spark, ["http://a/live-blog/x", "http://a/canli-altin", "http://a/VIDEO/1", "http://a/b"], "string", u.skip_reason) == ["live-blog", "canli-veri", "video", None]
    assert many(spark, [None, " ", "a.b", "http:///x", "http://a"], "string", u.validity) == ["empty", "empty", "no_scheme", "no_hostname", "ok"]
    assert many(spark, ["http://a/b/son-durum_ne-12ab34cd?x=1", "http://a/yeni-haber,123"], "string", u.provisional_title) == ["son durum ne", "yeni haber"]
    assert one(spark, u.page_urls(F.lit("http://a/b?page=3&x=1"), "page", 2, 2)) == ["http://a/b?x=1&page=2", "http://a/b?x=1&page=3"]


def national(first9):
    d = [int(c) for c in first9]
    d.append((sum(d[0:9:2]) * 7 - sum(d[1:8:2])) % 10)
    return "".join(map(str, [*d, sum(d) % 10]))


def test_redaction_in_order(spark):
    good, bad = national("123456789"), "12345678901"
    text = f"mail a.b@c.com iban TR33 0006 1005 1978 6457 8413 26 id 123e4567-e89b-12d3-a456-426614174000 ip 10.0.0.1 tc {good} not {bad} tel 0532 123 45 67."
    r = one(spark, pii.redact(F.lit(text)))
    assert r["text"] == f"mail [email_redacted] iban [iban_redacted] id [ref_redacted] ip [ip_redacted] tc [id_redacted] not {bad} tel [phone_redacted]."
    assert (r["email"], r["iban"], r["uuid"], r["ip"], r["tc"], r["phone"]) == (1, 1, 1, 1, 1, 1)
    empty = one(spark, pii.redact(F.lit(None).cast("string")))
    assert empty["text"] == "" and empty["email"] == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), min_size=0, max_size=12), min_size=1, max_size=6))
def test_window_burst(spark, series):
    def plain(b):
        n = len(b)
        if n < 3:
            return 0.0
        k = max(1, n // 3)
        base = b[:-k]
        return (statistics.fmean(b[-k:]) - statistics.fmean(base)) / max(statistics.pstdev(base), 1.0)

    got = many(spark, series, "array<int>", trend.window_burst)
    assert all(math.isclose(a, plain(b), abs_tol=1e-9) for a, b in zip(got, series, strict=True))


@pytest.mark.parametrize(
    ("cur", "prev", "rel", "burst", "state"),
    [(0, 2, None, 0, "fading"), (0, 0, None, 0, "stable"), (2, 0, None, 0.4, "developing"), (2, 0, None, 0.2, "stable"), (5, 5, 0.3, -0.5, "fading"), (5, 0, None, 1.0, "breaking"), (5, 5, 0.1, 1.0, "developing"), (5, 5, 0.01, 0.0, "developing"), (5, 5, -0.1, 0.0, "stable")],
)
def test_trend_state(spark, cur, prev, rel, burst, state):
    assert one(spark, trend.trend_state(F.lit(cur), F.lit(prev), F.lit(rel).cast("double"), F.lit(float(burst)))) == state


def test_momentum_and_scores(spark):
    assert one(spark, trend.momentum(F.lit(3), F.lit(2))) == 0.5
    assert one(spark, trend.momentum(F.lit(3), F.lit(0))) is None
    assert one(spark, trend.momentum(F.lit(0), F.lit(0))) == 0
    assert one(spark, trend.relative_momentum(F.lit(4), F.lit(2), F.lit(20), F.lit(10))) == 0
    assert one(spark, trend.relative_momentum(F.lit(4), F.lit(2), F.lit(20), F.lit(0))) == 1
    assert one(spark, trend.novelty(F.lit(12.0))) == 0.5
    assert one(spark, trend.freshness(F.lit(None).cast("double"))) == 0.5 and one(spark, trend.freshness(F.lit(24.0))) == 0.5
    assert one(spark, trend.importance(F.lit(10), F.lit(10))) == 1 and one(spark, trend.importance(F.lit(0), F.lit(0))) == 0


def test_sentences_and_chunks(spark):
    s = one(spark, t.sentences(F.lit("Bir cümle var. İkinci cümle! Üç? A. son 3.5 sayı. Tamam…")))
    assert "".join(s).replace(" ", "") == "Bircümlevar.İkincicümle!Üç?A.son3.5sayı.Tamam…" and len(s) >= 3
    body = " ".join(f"Sentence {i} has exactly seven words here." for i in range(120))
    cfg = DEFAULT
    chunks = one(spark, t.chunk(F.lit(body)))
    assert [c["chunk_index"] for c in chunks] == list(range(len(chunks))) and len(chunks) > 2
    assert all(c["token_count"] <= cfg.max_tokens + cfg.overlap_tokens for c in chunks)
    assert all(f"Sentence {i} has" in " ".join(c["chunk_text"] for c in chunks) for i in range(120))
    assert one(spark, t.chunk(F.lit(""))) == []


def test_text_kernels(spark):
    assert one(spark, t.kebab(F.lit("Hürmüz Boğazı / IŞIK"))) == "hurmuz-bogazi-isik"
    assert one(spark, t.trigram_similarity(F.lit("word"), F.lit("two words"))) == pytest.approx(4 / 11)
    assert one(spark, t.ngrams(F.array(*map(F.lit, "abc")), 1, 2)) == ["a", "b", "c", "a b", "b c"]
    spoiled = "a [ID: 1] b (id.2) c [Ref 3] d ( ref-4 ) e [KAYNAK:5] f (kaynak 6) g [source 7] h [8] i (source 9) [#10]"
    assert one(spark, t.repair_citations(F.lit(spoiled))) == "a [#1] b [#2] c [#3] d [#4] e [#5] f [#6] g [#7] h [8] i (source 9) [#10]"
    assert one(spark, t.normalize_title(F.lit(' -Şişli\'de "büyük"\u2003 çarşı!.'))) == "şişli'de \"büyük\" çarşı"
    assert one(spark, t.numeric_spans(F.lit("Yüzde 5 ve %10; 10  %, 3 ana kent, 16-14, 2. Hafta, MÖ 408, 5 Milyon TL, 5 milyon tl 1/3"))) == [
        "Yüzde 5", "%10", "10  %", "1/3", "5 Milyon TL", "3 ana kent", "16-14", "2. Hafta", "MÖ 408"]
    assert one(spark, t.citation_sentences(F.lit("Dr. Ali geldi. Prof. Dr. Veli gitti! TBMM. Ev vs. A. B. Şu?  Öyle."))) == [
        "Dr. Ali geldi.", "Prof. Dr. Veli gitti!", "TBMM. Ev vs. A.", "B.", "Şu?", "Öyle."]
    assert one(spark, t.citation_ids(F.lit("[#2][#1][#2]"))) == [2, 1]
    assert one(spark, t.cited_numbers(F.lit("[3] [1-3, 7] [W2]"))) == [1, 2, 3, 7]
    left = one(spark, t.remove_boilerplate(F.lit("Text of it.\n\nABONE OL\n\nTüm hakları saklıdır\n\nMore.")))
    assert left["text"] == "Text of it.\n\nMore." and left["removed"] == 0.5
    assert one(spark, t.remove_boilerplate(F.lit(" \n\n ")))["text"] == " \n\n "
    assert one(spark, t.language(F.lit("kısa")))["code"] == "tr"
    assert one(spark, t.language(F.lit("the cat of the house and the dog in the garden is that for to")))["code"] == "en"
    assert one(spark, t.normalize_query(F.lit(" “Ali'nin”  EVİ ".replace("İ", "I")))) == "alinin evi"


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(-1.0), F.lit(0.0))
    assert one(spark, v.cosine(a, b)) == -1 and one(spark, v.semantic(a, b)) == 0
    assert one(spark, v.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0
    assert one(spark, v.hamming(v.sign_bits(a), v.sign_bits(b))) == 1
    assert one(spark, v.parse(v.to_literal(a))) == [1.0, 0.0]


FEED = """<?xml version="1.0"?><rss xmlns:media="http://search.yahoo.com/mrss/"><channel><item><title>T</title><link>http://a/1</link><description>d</description>
<pubDate>Mon, 01 Jan 2024 10:00:00 +0300</pubDate><media:thumbnail url="http://i/t.jpg"/></item><item><title>no link</title></item></channel></rss>"""


def test_feeds_and_sitemaps(spark):
    items = web.feed_items(FEED)
    assert [(i["title"], i["link"], i["image"], i["published"].hour) for i in items] == [("T", "http://a/1", "http://i/t.jpg", 7)]
    assert web.feed_items("<rss>") == web.feed_items(None) == web.sitemap_entries("<!DOCTYPE x><urlset/>") == []
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>E</title><link href="http://a/e"/><updated>2024-01-01T00:00:00Z</updated></entry></feed>'
    assert web.feed_items(atom)[0]["link"] == "http://a/e" and web.feed_items(atom)[0]["published"].year == 2024
    assert web.sitemap_entries("<sitemapindex><sitemap><loc>http://s</loc></sitemap></sitemapindex>")[0]["kind"] == "sitemap"


def test_extraction_tiers():
    body = "Long enough sentence of the article. " * 10
    ld = f'<html><title>x</title><script type="application/ld+json">{{"@graph":[{{"@type":"NewsArticle","headline":"H","articleBody":"{body}","author":"A"}}]}}</script></html>'
    assert web.extract(ld)["tier"] == "jsonld" and web.extract(ld)["title"] == "H"
    dense = f"<html><head><title>D</title></head><body><article><h1>Head</h1><p>{body}</p><nav><p>{body}</p></nav></article></body></html>"
    x = web.extract(dense)
    assert x["tier"] == "density" and x["text"].count("Long enough") == 10 and x["title"] == "Head"
    assert web.extract(None)["tier"] == "meta"


def test_redaction_against_a_plain_version(spark):
    """All six stages over whole documents, beside the same stages with Python's expressions."""
    import re

    patterns = {n: re.compile(p.replace("(?U)", "")) for n, p, _ in pii.STAGES}
    marks = {n: m for n, _, m in pii.STAGES}
    rng = np.random.default_rng(4)
    bits = ["a.b@c.com", "TR330006100519786457841326", "123e4567-e89b-12d3-a456-426614174000", "10.0.0.1", national("123456789"), "12345678901", "0532 123 45 67", "+90(532)1234567", "x", "Şişli'de", "5321234567.", "\n"]
    texts = [" ".join(rng.choice(bits, int(rng.integers(0, 40)))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", pii.redact(F.col("t")).alias("r")).collect():
        text, counts = r["t"], {}
        for n, p in patterns.items():
            hits = [m for m in p.finditer(text) if n != "tc" or national(m[0][:9]) == m[0] and m[0][0] != "0"]
            counts[n] = len(hits)
            for m in reversed(hits):
                text = text[: m.start()] + marks[n] + text[m.end() :]
        assert r["r"].asDict() == {"text": text} | counts


def test_predicates(spark):
    from newsloom.functions import predicates as p

    df = spark.createDataFrame([(1, "Red Steel", None), (2, None, "1998-07-31 00:00:00"), (3, "wood", "1990-01-01 00:00:00")], "id int, name string, at string").withColumn("at", F.to_timestamp("at"))
    ids = lambda c: sorted(r["id"] for r in df.where(c).collect())
    assert ids(p.matches_any("name", ["steel", "gold"])) == [1] and ids(p.matches_any("name", [])) == []
    assert ids(p.within("at", "1998-08-01", 48)) == [1, 2] and ids(p.within("at", "1998-08-01", 1, "1989-01-01", "1991-01-01")) == [1, 3]
    assert ids(p.optional("id", None)) == [1, 2, 3] and ids(p.optional("id", 2)) == [2]
    assert ids(p.all_open(F.col("name") == "wood")) == [3] and ids(p.all_open()) == [1, 2, 3]
    order = lambda key: [r["id"] for r in df.withColumn("n", F.length("name")).orderBy(*p.sort_keys(key, {"n": float("inf"), "id": -1}), "id").collect()]
    assert order("n") == [2, 1, 3] and order("id") == [3, 2, 1] and order("no such key") == [2, 1, 3]


def test_canonical_entity(spark):
    from newsloom.functions.query import canonical_entity, query_words

    cases = [
        ("özgür özelle", "Özgür Özelle ne konuştu", "özgür özel"),
        ("özgür özel", "özgür özelle", "özgür özel"),
        ("özgür öz", "özgür özelle", None),
        ("filenin sultanları", "Filenin Sultanları kim", "filenin sultan"),
        ("rusya", "rusya boğazı", "rusya"),
        ("imamoğlu", "İmamoğlu'nun sözü", "imamoğlu"),
        ("15", "15 temmuz", "15"),
        ("uydurma", "başka söz", None),
        ("", "söz", None),
        (None, "söz", None),
    ]
    df = spark.createDataFrame(cases, "entity string, said string, want string")
    for r in df.select("*", canonical_entity(F.col("entity"), query_words(F.col("said"))).alias("got")).collect():
        assert r.got == r.want, r


def test_captions(spark):
    from newsloom.functions.content import enrich_caption

    ay = "Aziz Yıldırım"
    cases = [
        ("Logo önünde konuşan bir adam", ["kürsü", ay], "", f"Logo önünde konuşan {ay}"),
        ("Logo önünde", [ay], "", f"{ay}, logo önünde"),
        ("Yıldırım konuşuyor", [ay], "", "Yıldırım konuşuyor"),
        ("bir kadın", [ay], "başka bir haber", "bir kadın"),
        ("bir erkek adamın evi", ["A$1 B\\Q"], None, "A$1 B\\Q evi"),
        ("x", None, None, "x"),
        (None, [ay], None, ""),
        ("x", ["al", "küçük"], None, "x"),
    ]
    df = spark.createDataFrame(cases, "caption string, depicts array<string>, alt string, want string")
    for r in df.select("*", enrich_caption(F.col("caption"), F.col("depicts"), F.col("alt")).alias("got")).collect():
        assert r.got == r.want, r


def plain_semantic_chunks(text, cfg, embed, title):
    """One text by plain loops."""
    import re

    import numpy as np

    tokens = lambda s: int(len(s.split()) * 1.3)
    rows = []
    for p in (x.strip() for x in re.split(r"\n{2,}", text)):
        if not p:
            continue
        if p.startswith("#") or 5 <= len(p) <= 80 and p == p.upper() and p[-1] not in ".!?" and " " not in p[:20]:
            rows.append((p, True, True))
            continue
        sents = []
        for s in re.split(r"(?<=[.!?…])\s+(?=[A-ZÇĞİıÖŞÜ\"'“‘])", p):
            if len(s) < 3 and sents:
                sents[-1] += " " + s
            elif s:
                sents.append(s)
        rows += [(s, False, i == 0) for i, s in enumerate(sents)]
    if not rows:
        return []
    cut = {i for i, r in enumerate(rows) if r[1] and i}
    if embed:
        v = [np.asarray(embed(r[0]), float) for r in rows]
        sims = [float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))) if np.linalg.norm(a) * np.linalg.norm(b) else 0.0 for a, b in zip(v, v[1:], strict=False)]
        if len(sims) >= 4:
            bound = np.percentile(sims, cfg.percentile)
            cut |= {i + 1 for i, s in enumerate(sims) if s < bound and rows[i + 1][2]}
    chunks, now, n = [], [], 0
    if sum(tokens(r[0]) for r in rows) < cfg.min_tokens:
        chunks = [rows]
    else:
        for i, r in enumerate(rows):
            t = tokens(r[0])
            if now and (i in cut and n >= cfg.min_tokens or n + t > cfg.max_tokens or n + t > cfg.target_tokens and n >= cfg.min_tokens and r[2]):
                chunks.append(now)
                now, n = [], 0
            now, n = now + [r], n + t
        if chunks and n < cfg.min_tokens:
            chunks[-1] = chunks[-1] + now
        else:
            chunks.append(now)
    out = []
    for i, c in enumerate(chunks):
        body = ([r for r in chunks[i - 1][-cfg.overlap_sentences :] if not r[1]] if i else []) + c
        whole = (f"BAŞLIK: {title}\n\n" + " ".join(r[0] for r in body)).strip()
        out.append((i, whole, tokens(whole)))
    return out


def test_semantic_chunks(spark, small):
    from newsloom.functions.semantic import SemanticConfig, semantic_chunk

    docs = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").where("text is not null").orderBy("doc_id").limit(60).collect()]
    texts = ["\n\n".join(docs[i : i + 3]).replace(". ", ".\n\n", 3) + "\n\nGÜNDEM\n\n" + docs[i][:300] for i in range(0, 57, 3)] + ["", "  ", "Tek cümle.", "# Baş\n\nSöz."]
    vec = lambda s: [float(len(s)), float(s.count("e")), float(s.count("a")) - 2.0]
    count = lambda x, c: (F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))).cast("double")
    embed = lambda a: F.transform(a, lambda x: F.array(F.length(x).cast("double"), count(x, "e"), count(x, "a") - 2.0))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    for cfg in (SemanticConfig(), SemanticConfig(20, 50, 90, 1, 60)):
        for e, plain in ((embed, vec), (None, None)):
            got = {r.id: [tuple(c) for c in r.c] for r in df.select("id", semantic_chunk(F.col("text"), e, F.lit("Baş"), None, cfg).alias("c")).collect()}
            for i, t in enumerate(texts):
                assert got[i] == plain_semantic_chunks(t, cfg, plain, "Baş"), (cfg, i)


def test_body_images(spark):
    from newsloom.sources.images import absolute_image, page_images

    def found(html):
        rows = page_images(spark.createDataFrame([(1, "https://a.example/x/y.html", html)], "page_id long, url string, html string")).collect()
        return [(r["image_url"], r["alt"], r["caption"]) for r in sorted(rows, key=lambda r: r["position"])]

    assert found(None) == found("") == found("<p>text") == []
    assert found('<main><img src="b.jpg"><img src="../c.jpg"></main><img src="d.jpg">') == [("https://a.example/x/b.jpg", "", ""), ("https://a.example/c.jpg", "", "")]
    assert found('<div class="share-bar"><article><img src="a.jpg"></article></div><div class="Story"><img src="b.jpg" width="auto"></div>') == [("https://a.example/x/b.jpg", "", "")]
    assert found('<article><img src="data:x" data-src="e.jpg"><img src="/jeg-empty.png" data-srcset=" "><img src="f.jpg" alt="Haber logosu"></article>') == [("https://a.example/x/e.jpg", "", "")]
    assert found('<article><div data-ad-slot="1"><img src="a.jpg"></div><img src="https://x.taboola.com/b.jpg"><div id="ads"><p><img src="c.jpg"></p></div><figure><span>Kim</span><img src="d.jpg" alt="Kim"></figure></article>') == [("https://a.example/x/d.jpg", "Kim", "")]
    assert found('<article><div role="complementary"><img src="a.jpg"></div><div class="popular"><b><img src="b.jpg"></b></div><img src="c.jpg" height="199"><img src="c.jpg" height="400">') == []
    figure = '<figure><img src="g.jpg" alt="Two"><p>Two - by hand</p><aside>no</aside></figure><figure><figcaption>One <b>more</b></figcaption><img src="h.jpg">after</figure>'
    assert found(f"<body>{figure}</body>") == [("https://a.example/x/g.jpg", "Two", "by hand"), ("https://a.example/x/h.jpg", "", "One more")]
    assert [absolute_image(s, "") for s in ("//a/b.png", "", "c.png")] == ["https://a/b.png", "", "c.png"]


def test_national_id_with_a_negative_difference(spark):
    """Seven times the odd digits less than the even ones: the remainder is from 0 to 9, as in the reference."""
    assert national("120712080") == "12071208056" and national("131718040") == "13171804094"
    assert many(spark, ["12071208056", "13171804094", "12071208046"], "string", pii.valid_national_id) == [True, True, False]


def test_language_cuts_a_text_once(spark):
    """Its words are neither cut for each language nor again where the counts are used; a plain count gives the same."""
    texts = ["", "kısa", "der Mann und die Frau in dem Haus von der Stadt zu den Leuten", "x " * 40, "Ve bir\tbu için\u2003ile the of and " * 3, "de de de la la und the of and to in is that for bu"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string")
    found = df.select("i", t.language(F.col("t")).alias("l"))
    assert found._jdf.queryExecution().analyzed().toString().count("split(") == 1
    for r in found.collect():
        w = texts[r["i"]].lower().split()
        n = {c: sum(x in s for x in w) for c, s in t.STOP_WORDS.items()}
        best = max((k, c) for c, k in n.items())
        total = sum(n.values())
        want = ("tr", 0.0) if len(texts[r["i"]]) < 50 or not total else (best[1], best[0] / total)
        assert tuple(r["l"]) == want, texts[r["i"]]


def test_redaction_searches_texts_that_can_match(spark):
    """Each stage alone in a text, with digits of other scripts too, and what holds only part of what a match needs."""
    cases = {
        "a@b.com": "email", "TR12 3456 7890 1234 5678 9012 34": "iban", "abcdefab-abcd-abcd-abcd-abcdefabcdef": "uuid", "10.0.0.1": "ip", "10000000146": "tc",
        "٥٣٢-١٢٣-٤٥-٦٧": "phone", "TR no digits": None, "a-b . @": None, "1 TR @ - .": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", pii.redact(F.col("t")).alias("r"))
    for r in df.collect():
        counts = {n: r["r"][n] for n, _, _ in pii.STAGES}
        assert counts == {n: int(n == cases[r["t"]]) for n in counts} and (r["r"]["text"] == r["t"]) == (cases[r["t"]] is None), r
    assert set(pii.HOLDS) == {p for _, p, _ in pii.STAGES}
