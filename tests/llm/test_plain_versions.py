"""Plain versions of parts of the operators, and edge cases of labels, addresses, turns and single stages."""

import heapq
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from newsloom.llm import chat, packing, secrets, toxicity, urlfilter
from newsloom.llm import queries as q



def clash(*more):
    """Further columns under names that the operators use themselves."""
    return {n: F.lit("clash") for n in ("text_", "key", "n", "rank", "size", "rule", "block", "pos", "x", *more)}


def filled_by_pieces(histogram, capacity):
    """How full packs are when each piece, longest first, goes to the shortest pack, or to a new one."""
    packs = []
    for length in sorted(Counter(histogram).elements(), reverse=True):
        if packs and packs[0] + length <= capacity:
            heapq.heapreplace(packs, packs[0] + length)
        else:
            heapq.heappush(packs, length)
    return sorted(packs)


@pytest.mark.parametrize("seed", range(12))
def test_each_piece_goes_to_the_shortest_pack(seed):
    draw = random.Random(seed)
    capacity = draw.choice([7, 64, 100, 1024])
    histogram = Counter(draw.choice([draw.randint(1, capacity), draw.randint(1, 1 + capacity // 8), capacity, 1]) for _ in range(draw.choice([1, 30, 3000])))
    got = [sum(a * b for a, b in lengths) for lengths, packs in packing.shortest_pack_first(dict(histogram), capacity) for _ in range(packs)]
    assert sorted(got) == filled_by_pieces(histogram, capacity)


def test_added_kinds_of_secrets_against_expressions(docs_rows):
    draw, scan = random.Random(6), secrets.scanner()
    parts = ["gho_", "ghs_", "a1B2" * 9, "a1B2" * 8, "xoxb-", "xoxz-", "12-ab", "AIza", "Zz_-9" * 7, "eyJ", "eyJhbGci", ".", "Abc_-" * 6, "-----BEGIN ", "RSA ", "PRIVATE KEY", "PRIVATE KEY-----", "-----BEGIN RSA ", "eyJhbGci.eyJz.", ".eyJhbGciOiJIUzI1NiJ9.", "-----", " ", "\n", "é", "KEY"]
    texts = [t or "" for _, t, *_ in docs_rows] + ["".join(draw.choices(parts, k=draw.randint(1, 40))) for _ in range(3000)]
    found = Counter()
    for text in texts:
        data = text.encode()
        got = sorted((scan.rules[r].kind, a, b) for r, a, b in scan.spans(data) if scan.rules[r] in secrets.MORE)
        want = sorted((r.kind, m.start(), m.end()) for r in secrets.MORE for m in re.finditer(r.pattern.encode(), data) if len(m[0]) >= r.least)
        assert got == want, text
        found.update(k for k, _, _ in got)
    assert min(found[r.kind] for r in secrets.MORE) >= 20, found


def test_a_document_with_both_labels_is_toxic(spark, small):
    docs, labels = q.read_table(spark, small, "documents"), q.read_table(spark, small, "labels")
    plain = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels).collect()}
    again = labels.where("toxic = 1").withColumn("toxic", F.lit(0)).unionByName(labels).unionByName(labels).withColumns(clash("text", "source"))
    assert {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, again).collect()} == plain
    assert len(set(plain.values())) > 10


def test_very_long_addresses(spark):
    long = "a/" * 200_000
    urls = [f"http://example.com/de/{long}", f"https://x.net/{long}?utm_source=1", f"http://x.io/{long}ads/y", f"http://{'h.' * 50_000}org/fr/", f"http://x.io/{long}", "", None, f"http://x.io/?{'q=1&' * 100_000}gclid=2"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns(clash())
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.judge(pages).collect()}
    assert got == {0: ("example.com/de/", "block"), 1: ("net/", "block"), 2: (None, "block"), 3: ("org/fr/", "allow"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "block")}


def test_very_long_turns(spark):
    long = "</turn> ### \\h é" * 40_000
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", long), (1, 2, "assistant", long + "!"), (1, 3, "assistant", None), (2, 0, "assistant", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns(clash())
    back = chat.read_back(chat.windows(turns)).orderBy("conv_id", "window").collect()
    said = {c: [(t["role"], t["text"]) for r in back if r["conv_id"] == c for t in r["turns"]] for c in (1, 2)}
    assert said == {c: [(role, text or "") for k, _, role, text in rows if k == c] for c in (1, 2)}
    assert "".join(t for r in back if r["conv_id"] == 1 for t in r["loss_text"]) == long + "!"


def test_single_stages_with_null_ids_and_clashing_columns(spark, edge_dir, repeat_dir):
    """A row without an id goes through every stage; the columns are those of documents."""
    docs = q.read_table(spark, repeat_dir, "documents").withColumns(clash())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, repeat_dir)
        assert tuple(rows.columns) == corpus_pipeline.COLUMNS
        assert rows.where("doc_id is null").count() == 1, name
    pieces = corpus_pipeline.pack_sequences(spark, docs, repeat_dir)
    assert pieces.where("doc_id is null").agg(F.sum("length"), F.max("doc_tokens")).first()[0] > 1
