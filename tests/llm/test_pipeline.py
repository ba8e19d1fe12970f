import zlib

import numpy as np

import corpus_pipeline
from newsloom.llm import neardup, packing, quality, secrets, toxicity
from newsloom.llm import queries as q

from .test_queries import plain_components


def test_run_against_plain_steps(spark, small):
    from tokenizers import Tokenizer

    docs = [(r["doc_id"], r["text"]) for r in q.read_table(spark, small, "documents").collect()]
    texts = dict(docs)
    kept = [d for d, t in docs if quality.passes(next(quality.texts_of([(t or "").encode()])), list(quality.RULES))]
    rest = q.read_table(spark, small, "documents").where(q.F.col("doc_id").isin(kept))
    model = toxicity.fit(rest, q.read_table(spark, small, "labels"))
    kept = [d for d in kept if model is None or toxicity.score((texts[d] or "").encode(), model) < 0.5]
    groups = plain_components([(d, texts[d]) for d in kept], 5)
    kept = [d for d in kept if groups[d][1] == d]
    scan, t = secrets.scanner(), Tokenizer.from_file(q.tokenizer("byte_bpe_50k.json"))
    want = {}
    for d in kept:
        data, out, at = (texts[d] or "").encode(), [], 0
        for r, a, b in scan.spans(data):
            if a >= at:
                out += [data[at:a], f"[{scan.rules[r].kind}]".encode()]
            at = max(at, b)
        ids = np.array([*t.encode(b"".join([*out, data[at:]]).decode(), add_special_tokens=False).ids, 0], "<u4")
        want |= {(d, i): zlib.crc32(ids[i:j].tobytes()) for i, j in packing.cuts(len(ids), 1024)}
    got = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in corpus_pipeline.run(spark, small).collect()}
    assert got == want


def test_stages_return_the_columns_of_documents(spark, small):
    docs = q.read_table(spark, small, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "minhash_near_dedup", "secret_scans", "packing"]


def test_stages_on_an_empty_table(spark, empty_dir):
    assert corpus_pipeline.run(spark, empty_dir).count() == 0


def test_repeated_rows_leave_dedup_once(spark, repeat_dir):
    docs = q.read_table(spark, repeat_dir, "documents")
    rows = corpus_pipeline.keep_one_of_each_group(spark, docs, repeat_dir).collect()
    ids = [r["doc_id"] for r in rows]
    assert len(ids) == len(set(ids)) and ids.count(None) == 1
    groups = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()}
    assert {d for d in ids if d is not None} == {c for d, c in groups.items() if d is not None}


def test_edge_cases_go_through_all_stages(spark, edge_dir):
    """Nulls, empty and very long texts, a hot group of copies, columns with clashing names."""
    rows = corpus_pipeline.run(spark, edge_dir).collect()
    docs = {r["doc_id"]: r for r in q.read_table(spark, edge_dir, "documents").select(*corpus_pipeline.COLUMNS).collect()}
    texts = [docs[r["doc_id"]]["text"] for r in rows if r["start"] == 0]
    assert rows and all(texts) and len(texts) == len(set(texts))
