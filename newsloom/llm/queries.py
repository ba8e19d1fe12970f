"""One query for each operator, over its whole table, with production parameters; SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, codes, extraction, fingerprints, neardup, negatives, packing, quality, secrets, sharding, toxicity, urlfilter
from .common import read_table, staged

#: The example that a chat template must bear.
HARD_TURN = "\\### Assistant: </turn> ok"
SHARDS = 40


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose id is divisible by 20 are also looked up in the block tables of all fingerprints."""
    f = staged(fingerprints.fingerprints_with_next(read_table(spark, sf_dir, "documents")).withColumn("asked", F.col("doc_id") % 20 == 0))
    f = fingerprints.near_counts(f)
    name = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return f.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        name("own").alias("fingerprint"),
        name("edited").alias("edited_fingerprint"),
        fingerprints.likeness(F.col("own"), F.col("edited")).alias("near_edited"),
        fingerprints.likeness(F.col("own"), F.col("after")).alias("near_next"),
        "near_fingerprints",
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sharding.shard(read_table(spark, sf_dir, "documents"), SHARDS)
    return s.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = [r.kind for r in secrets.BASE]
    kinds = F.array(*(F.lit(r.kind) for r in secrets.RULES))

    def joined(spans) -> F.Column:
        # by start, then kind as listed
        keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("kind"), s["end"].alias("end"))))
        return F.array_join(F.transform(keyed, lambda k: F.concat_ws(":", F.element_at(kinds, k["kind"].cast("int")), k["start"].cast("string"), k["end"].cast("string"))), ",")

    listed = F.filter("spans", lambda s: s["kind"].isin(*base))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return secrets.scan(read_table(spark, sf_dir, "documents")).select("doc_id", *map(count, base), F.sha2(joined(listed), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op7_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(read_table(spark, sf_dir, "pages"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"), size=2)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of a conversation need all its turns in one row; nothing smaller defines them. They are
    gathered here, in the query; the operator's windows are bounded."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(F.lit(-7).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(HARD_TURN))
    back = chat.read_back(chat.windows(turns.union(hard.toDF(*turns.columns))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    part = F.struct("window", said.alias("said"), F.array_join("loss_text", "").alias("loss"))
    whole = back.groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("parts"), F.sum(F.size("turns")).alias("n_turns"), F.sum("formatted_chars").alias("formatted_chars"))
    text = lambda k: F.array_join(F.transform("parts", lambda p: p[k]), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(text("said"), 256).alias("turns_sha256"), F.length(text("loss")).cast("long").alias("loss_chars"), F.sha2(text("loss"), 256).alias("loss_sha256"), "formatted_chars"
    )


def op11_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extracted(spark, read_table(spark, sf_dir, "pages"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(e.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(read_table(spark, sf_dir, "embeddings"))


#: What stands in the article of the pages at hand; the operator doesn't know their layout.
SQL_EXTRACTION = r"""
    WITH parts AS (
      SELECT page_id, url, list_transform(string_split_regex(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '</?(?:p|h1)>'),
        lambda s: trim(regexp_replace(regexp_replace(s, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS p FROM pages),
    joined AS (SELECT page_id, url, array_to_string(list_filter(p, lambda s: s <> ''), chr(10) || chr(10)) AS t FROM parts),
    decoded AS (SELECT page_id, url, regexp_replace(regexp_replace(t, '&quot;?', '"', 'g'), '&amp;?', '&', 'g') AS text FROM joined)
    SELECT page_id, url, text, length(text) AS n_chars FROM decoded"""

SQL_NEGATIVES = """
    WITH kept AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x)::DOUBLE) AS v
      FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
    scored AS (
      SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
      FROM kept a JOIN kept b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT p.anchor_id, p.positive_id, row_number() OVER w AS rank, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
    FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
    WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id)
    QUALIFY row_number() OVER w <= 10"""


def sql_codes(rounds: int = 6, entries: int = 16, parts: int = 8) -> str:
    """All rounds as one chain of tables, by plain distances."""
    steps = [
        """kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x)::BIGINT) AS v FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding))""",
        f"""cut AS MATERIALIZED (SELECT vec_id, label, p, list_slice(v, p * (len(v) // {parts}) + 1, (p + 1) * (len(v) // {parts})) AS x
          FROM kept, range({parts}) r(p))""",
        f"""book0 AS MATERIALIZED (SELECT p, (row_number() OVER (PARTITION BY p ORDER BY vec_id)) - 1 AS e, x AS c FROM cut
          QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= {entries})""",
    ]
    for k in range(rounds + 1):
        steps.append(
            f"""near{k} AS MATERIALIZED (SELECT vec_id, label, p, x, min({{'d': d, 'e': e}}) AS best FROM (
              SELECT vec_id, label, cut.p, x, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
              FROM cut JOIN book{k} b ON cut.p = b.p) GROUP BY ALL)"""
        )
        if k < rounds:
            steps.append(
                f"""sums{k} AS (SELECT p, e, i, sum(y)::BIGINT AS s, count(*) AS n FROM (
                  SELECT p, best.e AS e, unnest(range(len(x))) AS i, unnest(x) AS y FROM near{k}) GROUP BY ALL)"""
            )
            steps.append(f"""means{k} AS (SELECT p, e, list((s - (s % n + n) % n) // n ORDER BY i) AS c FROM sums{k} GROUP BY ALL)""")
            steps.append(f"""book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN means{k} m ON m.p = b.p AND m.e = b.e)""")
    return f"""WITH {", ".join(steps)},
    coded AS (SELECT vec_id, label, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM near{rounds} GROUP BY vec_id, label),
    digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, digest"""


SQL_QUALITY = r"""
    WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    words AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
    grams AS (
      SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM words WHERE len(w) >= 8)),
    twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
    covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(8) r(k) GROUP BY doc_id),
    lines AS (
      SELECT doc_id, count(*) - count(DISTINCT line) AS n
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
    runs AS (
      SELECT doc_id, count(*) AS n FROM (SELECT doc_id, w, unnest(range(2, len(w) + 1)) AS i FROM words)
      WHERE w[i] = w[i - 1] GROUP BY doc_id),
    counted AS (
      SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        length(text) - length(replace(text, '!', '')) AS n_bangs,
        length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
        length(text) - length(regexp_replace(text, '[a-z]', '', 'g')) AS n_lower,
        coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, coalesce(runs.n, 0) AS n_runs
      FROM words LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN runs USING (doc_id)),
    judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 10 * n_bangs > 3 * n_words OR 10 * n_runs > 3 * n_words
           OR (n_words >= 20 AND n_upper > 0.5 * greatest(1, n_upper + n_lower))) AS kept
    FROM judged"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash, op2_packing, op3_quality, op4_toxicity, op5_sharding, op6_secrets, op7_urlfilter, op8_minhash, op9_bpe, op10_chat, op11_extraction, op12_negatives, op13_codes)
}
ORACLE_SQL: dict[str, str] = {"op3_quality": SQL_QUALITY, "op7_urlfilter": urlfilter.sql(), "op11_extraction": SQL_EXTRACTION, "op12_negatives": SQL_NEGATIVES, "op13_codes": sql_codes()}
