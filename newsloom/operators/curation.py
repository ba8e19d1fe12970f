"""Curation of training data, telemetry and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.config import DEFAULT, EngineConfig
from newsloom.functions.pii import redact


def with_question(turns: DataFrame) -> DataFrame:
    """Assistant turns with the latest user text strictly before them in their conversation."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("question", F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(before)).where("role = 'assistant'")


def split_of(key: Column) -> Column:
    """Train, validation or test by the first 32 bits of the key's SHA-256: 80, 10 and 10 of 100."""
    bucket = F.pmod(F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long"), F.lit(100))
    return F.when(bucket < 80, "train").when(bucket < 90, "validation").otherwise("test")


def eligibility(consent: Column, deleted: Column, feedback: Column, age_days: Column, edit_ratio: Column, length: Column, pii: Column, cfg: EngineConfig = DEFAULT) -> Column:
    """The first reason against a sample, or ``eligible``."""
    return (
        F.when(~F.coalesce(consent, F.lit(False)), "no_consent")
        .when(deleted, "deleted")
        .when(feedback < 0, "negative_feedback")
        .when(age_days < cfg.buffer_days, "too_recent")
        .when(edit_ratio >= cfg.max_edit_ratio, "edited")
        .when(length < 20, "too_short")
        .when(pii > 0, "pii")
        .otherwise("eligible")
    )


def curate(turns: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Question and answer pairs, both redacted, with the number of redactions and a split; pairs already curated
    (conv_id, turn) are left out, and so are answers without a question."""
    pairs = with_question(turns).where("question is not null")
    if done is not None:
        pairs = pairs.join(done, ["conv_id", "turn"], "left_anti")
    r = pairs.select("conv_id", "turn", redact(F.col("question")).alias("q"), redact(F.col("text")).alias("a"))
    count = sum((F.col(f"{x}.{k}") for x in "qa" for k in ("email", "iban", "uuid", "ip", "tc", "phone")), F.lit(0))
    return r.select("conv_id", "turn", F.col("q.text").alias("input"), F.col("a.text").alias("output"), count.cast("long").alias("redactions"), split_of(F.col("conv_id")).alias("split"))


def chat_payload(question: Column, answer: Column, sources: Column, most: int = 10) -> Column:
    """A conversation as JSON, with at most ``most`` sources."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.to_json(F.struct(F.array(turn("user", question), turn("assistant", answer)).alias("messages"), F.slice(sources, 1, most).alias("sources")))


def periods(rows: DataFrame, at: str, split: Column, value: str) -> DataFrame:
    """One row comparing the rows before and after a moment: counts, means, discrete percentiles, change in per cent."""
    tag = F.when(split, "b").otherwise("a")
    p = rows.groupBy(tag.alias("period")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95"))
    pick = lambda c, k: F.max(F.when(F.col("period") == k, F.col(c)))
    one = p.agg(*(pick(c, k).alias(f"{c}_{k}") for c in ("n", "mean", "p95") for k in "ab"))
    return one.withColumn("change_pct", (F.col("mean_b") - F.col("mean_a")) * 100 / F.nullif("mean_a", F.lit(0.0)))


def cost(input_tokens: Column, output_tokens: Column, per_million_in: Column, per_million_out: Column) -> Column:
    """In dollars, to the sixth decimal."""
    return F.round((input_tokens * per_million_in + output_tokens * per_million_out) / 1_000_000, 6)


def ranking_metrics(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """NDCG, precision, average precision, reciprocal rank and recall at k for each query of ``qrels`` (query_id, id,
    rel); ``run`` has (query_id, id, rank)."""
    hits = run.where(F.col("rank") <= k).join(qrels, ["query_id", "id"])
    hits = hits.withColumn("found", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    gain = lambda rel, rank: (F.pow(F.lit(2.0), rel) - 1) / F.log2(rank + 1)
    got = hits.groupBy("query_id").agg(F.sum(gain(F.col("rel"), F.col("rank"))).alias("dcg"), F.count(F.lit(1)).alias("n"), F.sum(F.col("found") / F.col("rank")).alias("ap"), F.min("rank").alias("first"))
    ideal = qrels.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rel"), "id")))
    best = ideal.groupBy("query_id").agg(F.sum(F.when(F.col("i") <= k, gain(F.col("rel"), F.col("i")))).alias("idcg"), F.count(F.lit(1)).alias("relevant"))
    j = best.join(got, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return j.select(
        "query_id", zero(F.try_divide("dcg", "idcg")).alias("ndcg"), zero(F.col("n") / k).alias("precision"), zero(F.col("ap") / F.least("relevant", F.lit(k))).alias("average_precision"),
        zero(1 / F.col("first")).alias("reciprocal_rank"), zero(F.col("n") / F.col("relevant")).alias("recall"),
    )


def vote(votes: DataFrame, key: str, value: str, tie: str = "inferred") -> DataFrame:
    """The most frequent value of each key; ``tie`` if several are."""
    c = votes.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    best = c.withColumn("top", F.max("n").over(Window.partitionBy(key))).where("n = top")
    return best.groupBy(key).agg(F.when(F.count(F.lit(1)) > 1, tie).otherwise(F.min(value)).alias("verdict"), F.max("n").alias("votes"))


def sliding_counts(events: DataFrame, key: str, seconds: Column | str, window: int, limit: int) -> DataFrame:
    """For each event how many of its key fall in the window that ends with it, whether that is within the quota, and
    when the oldest of them leaves."""
    s = F.col(seconds) if isinstance(seconds, str) else seconds
    by = Window.partitionBy(key).orderBy("s").rangeBetween(-(window - 1), 0)
    e = events.withColumn("s", s)
    return e.withColumn("used", F.count(F.lit(1)).over(by)).withColumn("allowed", F.col("used") <= limit).withColumn("reset_at", F.min("s").over(by) + window)


def latency_stats(calls: DataFrame, ms: str, at: str) -> DataFrame:
    """One row: how many calls, their mean, the values at half and at 95 % of the sorted latencies, and the last call. Counted by
    whole milliseconds first, so that only the distinct ones meet."""
    per = calls.groupBy(F.coalesce(F.col(ms), F.lit(0)).cast("long").alias("ms")).agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("at"))
    all_ = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(F.col("ms") * F.col("n")).alias("total"), F.array_sort(F.collect_list(F.struct("ms", "n"))).alias("by"), F.max("at").alias("last"))

    def at_share(share: float) -> Column:
        place = F.least(F.floor(F.col("n") * share), F.col("n") - 1)
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("ms"))
        step = lambda s, x: F.struct((s["seen"] + x["n"]).alias("seen"), F.coalesce(s["ms"], F.when(s["seen"] + x["n"] > place, x["ms"])).alias("ms"))
        return F.aggregate("by", start, step)["ms"].cast("double")

    return all_.select("n", F.round(F.try_divide("total", "n"), 2).alias("mean"), at_share(0.5).alias("p50"), at_share(0.95).alias("p95"), "last")


def samples(answers: DataFrame, done: DataFrame) -> DataFrame:
    """Training samples of answers (message_id, conv_id, question, text, edited, chosen, eligible, rejected) that are not among
    the ``done`` message ids: one ``sft`` row if eligible, a ``dpo_rejected`` row if rejected, and with it a ``dpo_chosen`` row where a
    better answer was given. An answer without a question gives none; one with personal data in any of its texts gives one row
    ``excluded``."""
    todo = answers.where((F.col("eligible") | F.col("rejected")) & F.col("question").isNotNull())
    todo = todo.join(done.where("message_id is not null").select("message_id").distinct(), "message_id", "left_anti")
    found = redact(F.concat_ws("\n", F.coalesce("question", F.lit("")), F.coalesce("text", F.lit("")), "edited", "chosen"))
    hits = sum((F.col(f"found.{k}") for k in ("email", "iban", "uuid", "ip", "tc", "phone")), F.lit(0))
    todo = todo.withColumn("found", found).withColumn("pii", hits > 0)
    row = lambda kind, when, out: F.when(when, F.struct(F.lit(kind).alias("sample_type"), out.alias("output")))
    better = F.col("rejected") & (F.coalesce("chosen", F.lit("")) != "")
    kinds = F.array(row("sft", F.col("eligible"), F.col("text")), row("dpo_rejected", F.col("rejected"), F.col("text")), row("dpo_chosen", better, F.col("chosen")))
    all_ = F.when(F.col("pii"), F.array(row("excluded", F.lit(True), F.lit(None).cast("string")))).otherwise(F.array_compact(kinds))
    return todo.select("message_id", split_of(F.col("message_id")).alias("split"), F.col("question").alias("input"), F.inline(all_))


def artifact_candidates(artifacts: DataFrame, revisions: DataFrame, done: DataFrame, oldest: int, buffer_days: int = 7, most: int | None = None) -> DataFrame:
    """Artifacts that may be curated, oldest first: consented, past the buffer, and either without an ``sft`` sample of their head
    revision, or edited by hand with one that says preference pairs apply while the chosen answer is missing. ``artifacts``
    (artifact_id, head_id, consented, age_days), ``revisions`` (revision_id, artifact_id, seq, parent_id, intent, query), ``done``
    (artifact_id, seq, sample_type, applicable); ``oldest`` is the greatest age looked at."""
    r = lambda c, *cols: revisions.select(*(F.col(x).alias(f"{c}_{x}") for x in ("revision_id", *cols)))
    first = revisions.where("seq = 1").select("artifact_id", F.col("query").alias("effective_query"))
    count = revisions.groupBy("artifact_id").agg(F.count(F.lit(1)).alias("revisions"))
    a = artifacts.where(F.col("consented") & (F.col("age_days") > buffer_days) & (F.col("age_days") <= oldest))
    a = a.join(r("head", "seq", "parent_id", "intent"), F.col("head_id") == F.col("head_revision_id"))
    a = a.join(r("parent", "seq"), F.col("head_parent_id") == F.col("parent_revision_id"), "left").join(first, "artifact_id").join(count, "artifact_id")
    has = lambda kind, cond=F.lit(True): F.max((F.col("sample_type") == kind) & cond)
    state = done.groupBy("artifact_id", F.col("seq").alias("head_seq")).agg(has("sft").alias("sft"), has("sft", F.coalesce("applicable", F.lit(False))).alias("pairs"), has("dpo_chosen").alias("chosen"))
    a = a.join(state, ["artifact_id", "head_seq"], "left")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    retry = F.col("head_intent").isin("freetext", "edit") & F.col("pairs") & no("chosen")
    out = a.where(no("sft") | F.coalesce(retry, F.lit(False))).select("artifact_id", "head_seq", "parent_seq", "effective_query", "revisions", no("sft").alias("fresh"), "age_days")
    return out if most is None else out.orderBy(F.desc("age_days"), "artifact_id").limit(most)
