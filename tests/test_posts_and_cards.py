"""The post scanner however replies are cut; weekly cards, aliases, soft 404s."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsloom.operators import clusters, entities
from newsloom.operators.ingest import soft_404
from newsloom.streaming.posts import Scanner

TEXT = st.text('ab"{}[]\\:, \nü', max_size=12)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.dictionaries(TEXT, st.one_of(TEXT, st.integers(), st.lists(TEXT, max_size=2), st.dictionaries(TEXT, TEXT, max_size=2)), max_size=3), max_size=4), st.lists(st.integers(0, 300), max_size=8), st.booleans())
def test_any_cut_gives_the_same_posts(posts, cuts, dense):
    text = json.dumps({"intro": '"posts" is a "posts', "posts": posts, "more": [{"a": 1}]}, separators=(",", ":") if dense else (", ", " : "))
    cuts = sorted({0, len(text), *(c for c in cuts if c < len(text))})
    found, state = [], None
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        s = Scanner(state)
        found += s.feed(text[a:b])
        state = s.state
    assert found == list(enumerate(posts))
    assert [x for c in (Scanner(),) for ch in text for x in c.feed(ch)] == found


def test_scanner_on_broken_replies():
    one = lambda s: Scanner().feed(s)
    assert one("") == one("{}") == one('{"posts": {"a": 1}}') == one('"posts": [1, {"a": 1}]') == one('"posts": [] {"a": 1}') == []
    assert one('"posts": [{"a": }, {"b": 2}') == [(0, {"b": 2})]  # a broken one has no number
    assert one('"posts"posts" : [{}]') == one('""posts"\n:\t[{}') == [(0, {})]
    s = Scanner()
    assert s.feed('"posts":[{"a":"' + "x" * 100_000) == [] and s.feed('"}') == [(0, {"a": "x" * 100_000})] and s.state[6] == ""


def test_weekly_cards(spark):
    daily = [("g", 3, 5, "tr"), ("g", 1, 5, "de"), ("g", 2, None, ""), ("g", 4, 3, "tr"), ("h", 9, 1, "a"), ("h", 8, 1, "b"), ("i", 7, None, None), ("j", 6, 1, "a")]
    points = ["p" * 300, "", None, *"abcdef"]
    reply = json.dumps({"title": "T", "summary": "S" * 3000, "key_points": points, "importance": 7})
    replies = [("g", f"```json\n{reply}\n```"), ("h", json.dumps({"title": "", "summary": "x"})), ("i", json.dumps({"title": "I", "summary": "y", "importance": "none"})), ("j", "no json")]
    got = clusters.weekly_cards(spark.createDataFrame(daily, "group string, id long, article_count int, country string"), spark.createDataFrame(replies, "group string, reply string"))
    got = {r["group"]: r for r in got.collect()}
    assert set(got) == {"g", "i"}
    g = got["g"]
    assert (g["cards"], g["representative"], g["country"], len(g["summary"]), g["importance"]) == (4, 1, "tr", 2000, 1.0)  # tr has 8 of 13
    assert g["key_points"] == ["p" * 200, *"abcde"]
    assert (got["i"]["country"], got["i"]["importance"], got["i"]["key_points"]) == (None, 0.5, [])


def test_alias_operations(spark):
    a = spark.createDataFrame([("x", "org", 1, "seed"), ("y", "org", 1, "wikidata"), ("x", "place", 3, "seed")], "alias string, type string, canonical_id long, source string")
    new = spark.createDataFrame([(" X ", "org", 2), ("z", "org", 2), ("z", "org", 5), (" ", "org", 2), (None, "org", 2)], "alias string, type string, canonical_id long")
    added = entities.add_aliases(a, new)
    assert sorted(tuple(r) for r in added.collect()) == [("x", "org", 2, "admin"), ("x", "place", 3, "seed"), ("y", "org", 1, "wikidata"), ("z", "org", 2, "admin")]
    gone = spark.createDataFrame([("x", "org", 1), ("Y", "org", 1)], "alias string, type string, canonical_id long")
    kept, missed = entities.remove_aliases(added, gone)
    assert {(r["alias"], r["type"]) for r in kept.collect()} == {("x", "org"), ("x", "place"), ("z", "org")} and [r["alias"] for r in missed.collect()] == ["x"]
    counts = entities.recount(spark.createDataFrame([(1, "a", 9), (2, "b", 9)], "id long, name string, alias_count long"), kept)
    assert {r["id"]: r["alias_count"] for r in counts.collect()} == {1: 0, 2: 2}


def test_soft_404(spark):
    article = '<script type="application/ld+json">{"@type": ["http://schema.org/Article"], "articleBody": "long"}</script>'
    cases = {
        "<title>Sayfa Bulunamadı</title>": True, "<title>Boeing 737-404</title>": False, "<title>404 | Hata</title>": True, "<p>This page  does not exist</p>": True, "x" * 1990 + "this page does not exist": False,
        "<title>Page not found</title>" + article: False, "<title>Page not found</title>" + article.replace("long", ""): True, "<title>Page not found</title>" + article.replace("Article", "WebPage", 1): True, "": False,
    }
    df = spark.createDataFrame([(i, h) for i, h in enumerate([*cases, None])], "i int, html string")
    got = {r["i"]: r["x"] for r in df.select("i", soft_404(F.col("html")).alias("x")).collect()}
    assert [got[i] for i in range(len(cases) + 1)] == [*cases.values(), False]


def test_languages(spark, medium):
    """Documents that the profiles were not made of."""
    from newsloom.operators import language

    d = spark.read.parquet(f"{medium}/documents.parquet")
    known = language.profiles(d.where("doc_id % 5 <> 0"))
    held = d.where("doc_id % 5 = 0 and length(text) >= 200")
    got = held.join(language.detect(held, known, "doc_id"), F.col("doc_id") == F.col("id"))
    share = got.agg(F.avg((F.col("code") == F.col("lang")).cast("double")), F.count("*")).first()
    print(f"language accuracy {share[0]:.4f} of {share[1]}")
    assert share[0] >= 0.97
    odd = language.detect(spark.createDataFrame([(1, None), (2, "short"), (3, "1234 " * 30)], "id long, text string"), known).collect()
    assert {(r["id"], r["code"], r["confidence"]) for r in odd} == {(1, "tr", 0.0), (2, "tr", 0.0), (3, "tr", 0.0)}


def plain_chunks(text, title, subtitle):
    """One text by plain loops: windows of sentences, each after the last words of the one before."""
    import re

    from newsloom.config import DEFAULT as cfg

    tokens = lambda s: int(len(s.split()) * cfg.token_coefficient)
    sents = []
    for p in (x.strip() for x in re.split(r"\n{2,}", text)):
        own = []
        for s in re.split(r"(?<=[.!?…])\s+(?=[A-ZÇĞİıÖŞÜ\"'“‘])", p) if p else []:
            if len(s) < 3 and own:
                own[-1] += " " + s
            elif s:
                own.append(s)
        sents += own
    done, cur, n = [], [], 0
    for s in sents:
        k = tokens(s)
        if k > cfg.max_tokens:
            done += [(cur, n)] * bool(cur) + [([s], k)]
            cur, n = [], 0
        elif n + k > cfg.target_tokens and n >= cfg.min_tokens or n + k > cfg.max_tokens:
            done += [(cur, n)] * bool(cur)
            cur, n = [s], k
        else:
            cur, n = [*cur, s], n + k
    if cur and n < cfg.min_tokens and done:
        done[-1] = (done[-1][0] + cur, done[-1][1] + n)
    elif cur:
        done.append((cur, n))
    bodies, out = [" ".join(w) for w, _ in done], []
    head = "".join(f"{m}: {t.strip()}\n\n" for m, t in (("BAŞLIK", title), ("ALT BAŞLIK", subtitle)) if t)
    for i, b in enumerate(bodies):
        tail = bodies[i - 1].split()[-int(cfg.overlap_tokens / cfg.token_coefficient) :] if i else []
        whole = (head + (" ".join(tail) + " " if i else "") + b).strip()
        out.append((i, whole, tokens(whole)))
    return out


def test_chunks_of_all_documents(spark, small):
    from newsloom import plans

    got = {}
    for r in plans.QUERIES["t11_chunks"](spark, small).collect():
        got.setdefault(r["id"], []).append((r["chunk_index"], r["chunk_text"], r["token_count"]))
    for d in spark.read.parquet(f"{small}/documents.parquet").collect():
        assert sorted(got.get(d["doc_id"], [])) == plain_chunks(d["text"] or "", d["source"], d["lang"]), d["doc_id"]
