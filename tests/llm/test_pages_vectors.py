"""Page extraction, hard negatives and vector codes against plain versions."""

import hashlib
import itertools
import math

import numpy as np
import pytest

from newsloom.llm import codes, extraction, layouts, negatives, queries, vantage
from newsloom.llm.blocks import blocks
from tests.oracle import differences

INF, NAN = float("inf"), float("nan")


@pytest.mark.parametrize("name", ["op11_extraction", "op12_negatives", "op13_codes"])
def test_sql(spark, medium, name):
    assert differences(queries.QUERIES[name](spark, medium), medium, queries.ORACLE_SQL[name]) == []


# pages


@pytest.fixture(scope="module")
def model():
    return extraction.standard_model()


def test_blocks():
    text = lambda h: [b.text for b in blocks(h)]
    assert text(None) == text("") == text("<p></p> \n") == []
    assert text('<p>a<p><b>b &amp c<br>d&nbsp; e</div><script>var t="</p><p>";</script>f<li>g<li>h') == ["a", "b & c d e", "f", "g", "h"]
    assert text('<p title="a > b">x</p><!-- y --> z <!-- w') == ["x", "z"]
    assert text("a < b <3 <p>c") == ["a < b <3", "c"]
    assert text("<p>a<p x='") == ["a"]
    assert text("<svg><p>a</p><select>b") == ["a", "b"]
    assert text("<table><tr><td>a<td>b<tr><td>c</table>d") == ["a", "b", "c", "d"]
    assert [b.link_chars for b in blocks("<p>ab<a href=/x>cd</a></p><p>e")] == [2, 0]
    deep = "<div>" * 50_000 + "x" + "</p>" * 50_000 + "<svg>" * 20_000 + "<" * 50_000 + '<a "' * 50_000
    assert blocks(deep)[0].text.startswith("x")


def test_viterbi_finds_the_likeliest_labels(model):
    for seed in range(9000, 9060):
        bs = blocks(layouts.page(seed)[0])[:9]
        own = extraction.scores(model, bs)
        total = lambda ys: sum(s for s, y in zip(own, ys, strict=True) if y) + sum(model.moves[extraction.way(a.at, b.at)][y][z] for a, b, y, z in zip(bs, bs[1:], ys, ys[1:], strict=False))  # noqa: B023, E731
        best = max(itertools.product((0, 1), repeat=len(bs)), key=total)
        assert math.isclose(total(extraction.viterbi(model, bs)), total(best), abs_tol=1e-9)


def test_gradient_is_that_of_the_likelihood():
    """Against sums over all labellings of three short chains, and small steps."""
    rng = np.random.default_rng(1)
    pages = [([list(rng.choice(6, 2, replace=False)) for _ in range(n)], [0, *rng.integers(0, 3, n - 1)], list(rng.integers(0, 2, n))) for n in (1, 4, 3)]
    chains, w = extraction.Chains(pages, 6), rng.normal(size=18)

    def plain(w):
        moves, out = w[6:].reshape(3, 2, 2), 0.0
        for fs, ways, ys in pages:
            value = lambda z: sum(w[f].sum() for f, y in zip(fs, z, strict=True) if y) + sum(moves[k, a, b] for k, a, b in zip(ways[1:], z, z[1:], strict=False))  # noqa: B023, E731
            out += value(ys) - np.log(sum(np.exp(value(z)) for z in itertools.product((0, 1), repeat=len(fs))))
        return out

    got, slope = chains.gradient(w)
    assert math.isclose(got, plain(w), rel_tol=1e-9)
    for i in range(18):
        step = np.eye(18)[i] * 1e-5
        assert abs((plain(w + step) - plain(w - step)) / 2e-5 - slope[i]) < 1e-6


def test_held_out_pages(model):
    right = total = 0
    for seed in range(500_000, 500_300):
        html, text = layouts.page(seed)
        bs = blocks(html)
        ys = extraction.labels(bs, text)
        right += sum(a == b for a, b in zip(ys, extraction.viterbi(model, bs), strict=True))
        total += len(ys)
    assert right / total >= 0.985, right / total


def test_a_page_of_each_kind(model):
    html = """<html><body><header class="site-header"><a href="/">Daily</a><p>News that matters.</p></header><div id="cookie-banner">We use cookies to improve your visit. Accept
      all.</div><main><article><h1>River  floods
      town</h1><p>The river rose overnight &amp; flooded the town.</p><div class="ad-slot">Buy our new shoes today, they are great.</div><p>Ok.</p><h2>What next</h2><p>It will fall.</article>
      <section id="comments"><h3>Comments</h3><div class="comment"><p>I was there, it was bad indeed.</p></div><form><label>Say</label><button>Send</button></form></section></main>
      <aside><h3>Related</h3><p>Another story about rain and the like.</p></aside><footer>&copy; Daily. All rights reserved.</footer>"""
    assert extraction.main_text(model, html) == "River floods town\n\nThe river rose overnight & flooded the town.\n\nOk.\n\nWhat next\n\nIt will fall."


def test_extract_edges(spark, model):
    article = "<nav><ul><li><a href=/>Home</a></ul></nav><article><h1>A title</h1><p>Some words, and more.</article><footer>&copy; x</footer>"
    long = "<nav><a href=/>Home</a></nav><article><h1>A title</h1>" + "<p>Some words, and more.</p>" * 20_000 + "</article>"
    rows = [(1, "u", article, "c"), (1, "u", article, "c"), (None, None, article, "c"), (2, None, None, "c"), (3, "u", "", "c"), (4, "u", long, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    want = "A title\n\nSome words, and more."
    got = sorted((r["page_id"] or 0, r["url"], r["text"], r["n_chars"]) for r in extraction.extract(df, model).collect() if r["page_id"] != 4)
    assert [g[2] for g in got] == [want, want, want, "", ""] and all(g[3] == len(g[2]) for g in got)
    big = extraction.extract(df, model).where("page_id = 4").first()
    assert big["text"] == "\n\n".join(["A title", *["Some words, and more."] * 20_000])
    assert extraction.extract(df.limit(0), model).count() == 0


def test_fit_reads_labelled_pages(spark):
    df = spark.createDataFrame([*(layouts.page(s) for s in range(60)), (None, "x"), ("<p>a", "not of this page"), ("<p>a", None)], "html string, text string")
    assert extraction.fit(df, 40).weights
    with pytest.raises(ValueError, match="nothing to learn from"):
        extraction.fit(df.limit(0))


# vectors


def plain_negatives(rows, scale, anchor, k, m, low, high):
    kept = [(i, label, [math.floor(scale * x) for x in v]) for i, label, v in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, label, v in kept:
        if i is None or i % anchor:
            continue
        dot = lambda w: sum(a * b for a, b in zip(v, w, strict=False))  # noqa: B023, E731
        order = lambda found: sorted(found, key=lambda f: (-f[0], f[1] is None, f[1] or 0))
        near = order((dot(w), j) for j, other, w in kept if j != i and other == label)[:k]
        far = order((dot(w), j) for j, other, w in kept if j != i and other != label)
        for p, j in near:
            fits = [(s, n) for s, n in far if low * p <= 100 * s <= high * p][:m]
            out += [(i, j, r + 1, n, p, s) for r, (s, n) in enumerate(fits)]
    return sorted(out, key=str)


def vector_rows(n=700, dims=6, copies=120):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, dims))
    rows = [(i, int(i % 3), (centres[i % 8] + 0.4 * rng.normal(size=dims)).tolist()) for i in range(n)]
    rows += [(n + i, i % 2, rows[3][2]) for i in range(copies)]  # one vector, two labels
    rows += [(7000, 1, rows[3][2]), (7000, 1, rows[3][2]), (7000, 2, rows[5][2])]  # a repeated anchor, and its id once more
    rows += [(None, 1, rows[0][2]), (8000, None, rows[0][2]), (8001, 1, None), (8002, 1, [1.0, None]), (8003, 1, [NAN] * dims), (8004, 1, [INF] * dims), (8100, 0, [0.0] * dims), (8101, 0, []), (8102, 2, [0.5, 0.5])]
    return rows


@pytest.mark.parametrize("block,sample", [(4096, 4096), (64, 256), (40, 64)])
def test_negatives_equal_brute_force(spark, block, sample):
    rows = vector_rows()
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, label int, embedding array<double>, qid string, cell int")
    got = negatives.mine(df, "vec_id % 50 = 0", positives=3, negatives=4, low=20, high=80, block_rows=block, sample_rows=sample)
    got = [tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got.collect()]
    assert sorted(got, key=str) == plain_negatives(rows, 256, 50, 3, 4, 20, 80)
    assert negatives.mine(df.limit(0), "vec_id % 50 = 0").count() == 0
    assert negatives.mine(df.where("label is null"), "vec_id % 50 = 0").count() == 0


def test_search_visits_few_leaves():
    """Rows of far groups are passed over; what is found is what all rows would give."""
    rng = np.random.default_rng(2)
    x = np.floor(256 * np.concatenate([c + 0.02 * rng.normal(size=(600, 8)) for c in rng.normal(size=(12, 8))]))
    m2 = float((x * x).sum(1).max())
    tree = vantage.build(vantage.augmented(x, m2), vantage.depth_for(len(x), 64))
    ids = np.arange(len(x))[tree.order]
    rows = vantage.Rows(tree, ids, (ids % 4), x[tree.order])
    q = x[::97]
    qs = vantage.Queries(np.arange(len(q)), np.arange(len(x))[::97], q, (q * q).sum(1), (np.arange(len(x)) % 4)[::97], np.full(len(q), -INF), np.full(len(q), INF))
    at, score, found, scored = vantage.search(rows, qs, m2, 5, True)
    for j in range(len(q)):
        s = x @ q[j]
        want = sorted((-s[i], i) for i in range(len(x)) if i % 4 == qs.label[j] and i != qs.own[j])[:5]
        assert [(-a, b) for a, b in zip(score[at == j], found[at == j], strict=True)] == want
    assert scored < 0.35 * len(q) * (len(tree.edges) - 1), scored


def test_negatives_refuse_what_cannot_be_summed(spark):
    df = spark.createDataFrame([(0, 1, [1e12, 1.0])], "vec_id long, label int, embedding array<double>")
    with pytest.raises(Exception, match="too large for exact sums"):
        negatives.mine(df, "true").count()


def plain_codes(rows, scale, parts, entries, rounds):
    kept = [(i, label, [math.floor(scale * x) for x in v]) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dims = -(-max(len(k[2]) for k in kept) // parts) * parts
    width = dims // parts
    kept = [(i, label, v + [0] * (dims - len(v))) for i, label, v in kept]
    part = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda k: (k[0] is None, k[0] or 0, k[2]))[:entries]
    books = [[part(k[2], p) for k in first] for p in range(parts)]
    best = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for k in kept:
                own.setdefault(best(part(k[2], p), books[p])[1], []).append(part(k[2], p))
            books[p] = [[sum(c) // len(own[e]) for c in zip(*own[e], strict=True)] if e in own else c for e, c in enumerate(books[p])]
    told = [(k[0], k[1], [best(part(k[2], p), books[p]) for p in range(parts)]) for k in kept]
    sums = {}
    for _, label, t in told:
        sums[label] = sums.get(label, 0) + sum(d for d, _ in t)
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for _, e in t), sum(d for d, _ in t), sums[label], digest) for i, label, t in told), key=str)


@pytest.mark.parametrize("n,parts,entries,rounds", [(300, 3, 16, 4), (300, 2, 5, 6), (60, 4, 250, 2)])
def test_codes_equal_brute_force(spark, n, parts, entries, rounds):
    rows = vector_rows(n, copies=n // 4)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, label int, embedding array<double>, code string, v int")
    got = codes.compress(df, scale=64, parts=parts, entries=entries, rounds=rounds)
    assert sorted((tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in got.collect()), key=str) == plain_codes(rows, 64, parts, entries, rounds)
    assert codes.compress(df.limit(0)).count() == 0


def test_codes_have_two_digits(spark):
    with pytest.raises(ValueError, match="256"):
        codes.compress(spark.createDataFrame([], "vec_id long, label int, embedding array<double>"), entries=257)


def test_partial_distances_drop_entries():
    rng = np.random.default_rng(4)
    x, book = rng.integers(-2000, 2000, (3000, 8)), rng.integers(-2000, 2000, (16, 8))
    book[9] = book[2]
    x[5] = (book[0] + book[1]) // 2
    at, d, spent = codes.nearest(x, book)
    full = ((x[:, None] - book[None]) ** 2).sum(2)
    assert (at == full.argmin(1)).all() and (d == full.min(1)).all()
    assert spent < 0.9 * x.size * len(book)  # nothing is near anything
    y = np.floor(book[rng.integers(0, 16, 3000)] + rng.normal(0, 400, (3000, 8))).astype(np.int64)
    at, d, spent = codes.nearest(y, book)
    full = ((y[:, None] - book[None]) ** 2).sum(2)
    assert (at == full.argmin(1)).all() and (d == full.min(1)).all()
    assert spent < 0.6 * y.size * len(book)  # rows near entries, as codebooks have them
