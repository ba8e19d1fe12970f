"""Entities: canonical names, token-subset groups, anchors, genericness, co-occurrence, parents."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.catalog import scratch
from newsloom.config import DEFAULT, EngineConfig
from newsloom.operators.patterns import found

#: Who may overrule whom in canonical names.
AUTHORITY = ("admin", "wikidata", "seed", "token_subset")
ANCHOR_TYPES = ("person", "org", "event", "place", "product")


def strip_titles(name: Column, titles: tuple[str, ...]) -> Column:
    """Leading titles removed, as many as there are."""
    return F.regexp_replace(name, rf"^(?:(?:{'|'.join(titles)})\.?\s+)+", "")


def resolve(entities: DataFrame, aliases: DataFrame, titles: tuple[str, ...] = ("dr", "prof", "mr", "ms", "sn", "sayin")) -> DataFrame:
    """Canonical names of (norm, type): by alias, for persons else by the name without titles, else null. ``aliases``
    has one row for each (alias, type)."""
    a = aliases.select(F.col("alias").alias("norm"), "type", F.col("canonical").alias("direct"))
    b = aliases.where("type = 'person'").select(F.col("alias").alias("bare"), F.col("type"), F.col("canonical").alias("stripped"))
    e = entities.withColumn("bare", strip_titles(F.col("norm"), titles))
    return e.join(a, ["norm", "type"], "left").join(b, ["bare", "type"], "left").withColumn("canonical", F.coalesce("direct", "stripped")).drop("bare", "direct", "stripped")


def subset_edges(entities: DataFrame) -> DataFrame:
    """Edges (norm, up) from a name to the one it is part of: the names with the same tokens, and of names with all its
    tokens and more the smallest, if just one is smallest. Names of two tokens at least. Candidates meet on
    their rarest token, so no pair is tried that shares none."""
    tok = F.array_sort(F.array_distinct(F.split("norm", " ")))
    e = entities.select("norm", tok.alias("tok")).distinct().where(F.size("tok") >= 2)
    df = e.select(F.explode("tok").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    rare = e.select("norm", "tok", F.explode("tok").alias("t")).join(df, "t").groupBy("norm", "tok").agg(F.min_by("t", F.struct("df", "t")).alias("t"))
    wide = e.select(F.col("norm").alias("up"), F.col("tok").alias("up_tok"), F.explode("tok").alias("t"))
    pairs = rare.join(wide, "t").where((F.col("norm") != F.col("up")) & (F.size(F.array_except("tok", "up_tok")) == 0))
    same = pairs.where("size(tok) = size(up_tok)").select("norm", "up")
    more = pairs.where("size(up_tok) > size(tok)").withColumn("n", F.size("up_tok"))
    least = more.withColumn("low", F.min("n").over(Window.partitionBy("norm"))).where("n = low")
    return same.union(least.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("norm"))).where("c = 1").select("norm", "up"))


def propagate(edges: DataFrame, a: str, b: str, rounds: int = 1000) -> DataFrame:
    """Connected groups of names: every node takes the least name among its neighbours', and that name's own least
    name, until nothing changes; an error if ``rounds`` don't suffice. Each round is a written table."""
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    e = e.union(e.select("y", "x")).distinct()
    e = _cut(e)
    label = e.select("x").distinct().withColumn("label", F.col("x"))
    seen = None
    for _ in range(rounds):
        near = e.join(label.select(F.col("x").alias("y"), "label"), "y").groupBy("x").agg(F.min("label").alias("near"))
        nxt = label.join(near, "x", "left").select("x", F.least("label", F.coalesce("near", "label")).alias("label"))
        jump = nxt.select(F.col("x").alias("label"), F.col("label").alias("over"))
        label = _cut(nxt.join(jump, "label", "left").select("x", F.coalesce("over", "label").alias("label")))
        state = label.agg(F.bit_xor(F.xxhash64("x", "label")), F.count(F.lit(1))).first()
        if state == seen:
            return label.select(F.col("x").alias("node"), F.col("label").alias("group"))
        seen = state
    raise RuntimeError(f"groups still change after {rounds} rounds")


def _cut(df: DataFrame) -> DataFrame:
    """``df`` as a written table of the shared folder (``catalog.scratch``): computed once, known in size to later joins, and not lost with an executor. The tables go
    when the session ends."""
    spark = df.sparkSession
    path = f"{_tables(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_folders: dict[str, str] = {}


def _tables(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = f"{scratch(spark)}/tables-{app}"
        atexit.register(_remove, spark, _folders[app])
    return _folders[app]


def _remove(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone, and its folder with it
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def subset_groups(entities: DataFrame) -> DataFrame:
    """(norm, canonical): groups of names joined by the edges above; the most frequent name of a group stands for it,
    then the longest, then the first. ``entities`` has (norm, freq)."""
    found = propagate(subset_edges(entities), "norm", "up")
    named = found.join(entities.select(F.col("norm").alias("node"), "freq"), "node")
    best = named.groupBy("group").agg(F.max(F.struct("freq", F.length("node").alias("n"))).alias("top"))
    first = named.join(best, "group").where("freq = top.freq and length(node) = top.n").groupBy("group").agg(F.min("node").alias("canonical"))
    return named.join(first, "group").select(F.col("node").alias("norm"), "canonical")


def by_authority(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key: the one of the highest authority, then the first canonical name."""
    order = F.array_position(F.array(*map(F.lit, AUTHORITY)), F.col("source"))
    return rows.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(order, "canonical"))).where("_i = 1").drop("_i")


def genericness(names: DataFrame, entities: DataFrame) -> DataFrame:
    """In how many other entities each name occurs as a substring. Candidates meet on the name's first token, which a
    containing entity must hold within one of its own; names with a shorter one are looked for all at once. Both sides are distinct names, not mentions."""
    n = names.select("norm").withColumn("probe", F.element_at(F.split("norm", " "), 1))
    n = n.withColumn("probe", F.substring("probe", -3, 3))
    grams = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("e") - 2, F.lit(1))), lambda i: F.substring(F.col("e"), i, F.lit(3)))))
    e = entities.select(F.col("norm").alias("e")).select("e", grams.alias("gram"))
    short = n.where(F.length("probe") < 3)
    hits = n.where(F.length("probe") == 3).join(e, F.col("probe") == F.col("gram")).where(F.contains("e", "norm") & (F.col("e") != F.col("norm"))).select("norm", "e")
    named = entities.select(F.col("norm").alias("id"), F.array("norm").alias("fields"))
    loose = found(named, short.select(F.col("norm").alias("pattern"))).select(F.col("pattern").alias("norm"), F.col("id").alias("e")).where(F.col("e") != F.col("norm"))
    per = hits.union(loose).groupBy("norm").agg(F.countDistinct("e").alias("genericness"))
    return names.select("norm").join(per, "norm", "left").select("norm", F.coalesce("genericness", F.lit(0).cast("long")).alias("genericness"))


def rank_anchors(candidates: DataFrame, cfg: EngineConfig = DEFAULT, prefer: str = "canonical", types: tuple[str, ...] = ANCHOR_TYPES) -> DataFrame:
    """Anchors in order within each ``group``: candidates (group, norm, type, df, sources, has_canonical, genericness)
    with enough articles and sources, that are no part of another such name and not generic (places may be)."""
    ok = candidates.where((F.trim("norm") != "") & F.col("type").isin(*types) & (F.col("df") >= cfg.min_articles) & (F.coalesce("sources", F.lit(0)) >= cfg.min_sources))
    # a group's candidates are the few names of one query or cluster
    o = ok.select("group", F.col("norm").alias("other")).distinct()
    part = ok.join(o, "group").where((F.col("norm") != F.col("other")) & F.contains("other", "norm")).select("group", "norm").distinct()
    ok = ok.join(part, ["group", "norm"], "left_anti")
    generic = F.coalesce(F.col("genericness"), F.lit(0)) >= cfg.generic_anchor_max
    ok = ok.where(~(generic & (F.col("type") != "place")))
    named = F.when(F.col("has_canonical"), 0).otherwise(1)
    order = [generic.cast("int"), F.desc("df"), named, "norm"] if prefer == "df" else [named, generic.cast("int"), F.desc("df"), "norm"]
    return ok.withColumn("rank", F.row_number().over(Window.partitionBy("group").orderBy(*order)))


#: Clusters of a user from which on the pairs are dealt, and clusters of a tile.
MANY, PAIR_TILE = 512, 256


def cooccurrence(memberships: DataFrame, many: int = MANY, tile: int = PAIR_TILE) -> DataFrame:
    """How many users have both clusters, a < b: ``memberships`` has distinct (user_id, cluster). A user of more than ``many`` clusters is
    dealt into tiles, every two of which meet apart: no task makes more than a tile's square of pairs for one user."""
    m = memberships.select("user_id", "cluster")
    sized = m.join(m.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > many), "user_id", "left")
    light, heavy = sized.where("n is null").drop("n"), sized.where("n is not null")
    a, b = light.select("user_id", F.col("cluster").alias("a")), light.select("user_id", F.col("cluster").alias("b"))
    tiles = F.ceil(F.col("n") / tile).cast("int")
    placed = heavy.select("user_id", "cluster", tiles.alias("tiles")).withColumn("own", F.pmod(F.xxhash64("cluster"), F.col("tiles")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    left, right = placed.withColumn("j", every).select("user_id", F.col("own").alias("i"), "j", F.col("cluster").alias("a")), placed.withColumn("i", every).select("user_id", "i", F.col("own").alias("j"), F.col("cluster").alias("b"))
    both = a.join(b, "user_id").where("a < b").select("a", "b").unionByName(left.join(right, ["user_id", "i", "j"]).where("a < b").select("a", "b"))
    return both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("support"))


def infer_parents(memberships: DataFrame, least: int = 3, high: float = 0.6, low: float = 0.35, ratio: float = 1.5) -> DataFrame:
    """(child, parent, strength): most of the child's users have the parent, few of the parent's have the child, and the
    parent co-occurs with clearly more clusters. The strongest parent stays, ties by the least id."""
    pairs = cooccurrence(memberships).where(F.col("support") >= least)
    all_pairs = cooccurrence(memberships)
    occ = memberships.groupBy("cluster").agg(F.count(F.lit(1)).alias("occ"))
    df = all_pairs.select(F.explode(F.array("a", "b")).alias("cluster")).groupBy("cluster").agg(F.count(F.lit(1)).alias("df"))
    facts = occ.join(df, "cluster", "left").select("cluster", "occ", F.coalesce("df", F.lit(0)).alias("df"))
    both = pairs.select(F.col("a").alias("parent"), F.col("b").alias("child"), "support").union(pairs.select("b", "a", "support"))
    p, c = (facts.select(F.col("cluster").alias(k), F.col("occ").alias(f"occ_{k}"), F.col("df").alias(f"df_{k}")) for k in ("parent", "child"))
    j = both.join(p, "parent").join(c, "child").withColumn("strength", F.col("support") / F.col("occ_child"))
    j = j.where((F.col("strength") >= high) & (F.col("support") / F.col("occ_parent") <= low) & (F.col("df_parent") >= F.col("df_child") * ratio) & (F.col("occ_parent") >= F.col("occ_child")))
    return j.withColumn("i", F.row_number().over(Window.partitionBy("child").orderBy(F.desc("strength"), "parent"))).where("i = 1").select("child", "parent", "strength")


def dominant(mentions: DataFrame, key: str, types: tuple[str, ...]) -> DataFrame:
    """The entity with most mentions of each cluster, of the types that anchor topics; ties by name."""
    s = mentions.where(F.col("entity_type").isin(*types)).groupBy(key, "entity_norm", "entity_type").agg(F.sum("mention_count").alias("n"))
    return s.withColumn("i", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "entity_norm", "entity_type"))).where("i = 1").drop("i")


def from_extraction(raw: DataFrame, types: tuple[str, ...] = ("person", "org", "place", "event", "product"), most: int = 40) -> DataFrame:
    """Mentions out of an extractor's JSON: ``raw`` has (article_id, title, subtitle, body, json) with an array of text and
    type. The first few, other types as misc, names of 2 to 200 characters, no noise, each name and type once;
    with where it first stands and how often, at most 999."""
    from newsloom.functions.query import is_noise, safe_lower
    from newsloom.functions.text import let

    kind = "array<struct<text:string,type:string>>"
    items = F.slice(F.coalesce(F.from_json("json", kind), F.array().cast(kind)), 1, most)
    type_of = lambda x: F.when(F.lower(x["type"]).isin(*types), F.lower(x["type"])).otherwise("misc")
    named = F.transform(items, lambda x, i: F.struct(i.alias("i"), x["text"].alias("text"), F.trim(safe_lower(x["text"])).alias("norm"), type_of(x).alias("type")))
    fit = F.filter(named, lambda x: F.length(x["norm"]).between(2, 200) & ~is_noise(x["norm"]))
    key = lambda x: F.struct(x["norm"], x["type"])
    once = let(fit, lambda f: let(F.transform(f, key), lambda keys: F.filter(f, lambda x, i: F.array_position(keys, key(x)) == i + 1)))
    # the texts are read here, beside their names: what is dealt out afterwards are names without texts
    low = lambda c: safe_lower(F.coalesce(c, F.lit("")))
    e = raw.select("article_id", once.alias("named"), low("title").alias("title"), low("subtitle").alias("subtitle"), safe_lower(F.concat_ws(" ", "title", "subtitle", "body")).alias("whole"))
    place = lambda n: F.when(F.contains("title", n), "title").when(F.contains("subtitle", n), "subtitle").otherwise("body")
    count = lambda n: ((F.length("whole") - F.length(F.replace("whole", n, F.lit("")))) / F.length(n)).cast("int")
    told = F.transform("named", lambda x: F.struct(x["i"], x["text"], x["norm"], x["type"], place(x["norm"]).alias("place"), count(x["norm"]).alias("n")))
    e = e.select("article_id", F.inline(told))
    e = e.withColumn("first", F.row_number().over(Window.partitionBy("article_id", "norm", "type").orderBy("i"))).where("first = 1")
    return e.select("article_id", F.col("text").alias("entity_text"), F.col("norm").alias("entity_norm"), F.col("type").alias("entity_type"), F.col("place").alias("first_position"), F.least(F.greatest("n", F.lit(1)), F.lit(999)).alias("mention_count"))


def resolve_cluster(answers: DataFrame, asked: DataFrame, cited: DataFrame) -> DataFrame:
    """One cluster for each message: the best that the answer names, else the best that the query names, else of the cited
    ones the best whose first word starts with a query word's first four letters. Each input has (message_id, cluster, rank);
    ``cited`` also ``overlap``."""
    tiers = [answers.select("message_id", "cluster", "rank", F.lit(0).alias("tier")), asked.select("message_id", "cluster", "rank", F.lit(1).alias("tier")), cited.where("overlap").select("message_id", "cluster", "rank", F.lit(2).alias("tier"))]
    every = tiers[0].unionByName(tiers[1]).unionByName(tiers[2])
    return every.withColumn("i", F.row_number().over(Window.partitionBy("message_id").orderBy("tier", "rank", "cluster"))).where("i = 1").drop("i", "rank")


def secondary_clusters(ranked: DataFrame, primary: DataFrame, most: int = 3) -> DataFrame:
    """The next best clusters of a message besides its primary one."""
    rest = ranked.join(primary.select("message_id", "cluster"), ["message_id", "cluster"], "left_anti")
    return rest.withColumn("place", F.row_number().over(Window.partitionBy("message_id").orderBy("rank", "cluster"))).where(F.col("place") <= most)


def find_or_create(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """Clusters for names (key, canonical_id): an existing one of the same canonical id, else of the same key or an alias, oldest
    first; ``created`` where there is none."""
    by_id = wanted.join(existing.where("canonical_id is not null").select(F.col("id").alias("found"), "canonical_id", "created_at"), "canonical_id").select("key", "found", F.lit(0).alias("tier"), "created_at")
    names = existing.select(F.col("id").alias("found"), F.explode(F.array_distinct(F.concat(F.array("key"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("key"), "created_at")
    by_key = wanted.join(names, "key").select("key", "found", F.lit(1).alias("tier"), "created_at")
    best = by_id.unionByName(by_key).withColumn("i", F.row_number().over(Window.partitionBy("key").orderBy("tier", "created_at", "found"))).where("i = 1").select("key", "found")
    return wanted.join(best, "key", "left").withColumn("created", F.col("found").isNull())


def merge_canonicals(aliases: DataFrame, moves: DataFrame) -> DataFrame:
    """Aliases re-pointed from merged canonical names (source) to the ones that stay (target), once each."""
    j = aliases.join(moves, aliases["canonical_id"] == moves["source"], "left")
    return j.select("alias", "type", F.coalesce("target", "canonical_id").alias("canonical_id")).distinct()


def add_aliases(aliases: DataFrame, new: DataFrame) -> DataFrame:
    """Aliases (alias, type, canonical_id, source) with ``new`` ones (alias, type, canonical_id), set by an admin: they take over what pointed elsewhere. Blank ones are
    left out; of one alias given twice the least canonical id counts."""
    fresh = new.select(F.lower(F.trim("alias")).alias("alias"), "type", "canonical_id").where("alias <> ''").groupBy("alias", "type").agg(F.min("canonical_id").alias("canonical_id"))
    kept = aliases.join(fresh.select("alias", "type"), ["alias", "type"], "left_anti").select("alias", "type", "canonical_id", "source")
    return kept.unionByName(fresh.withColumn("source", F.lit("admin")))


def remove_aliases(aliases: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Aliases without those of ``gone`` (alias, type, canonical_id) that point to that canonical name; and those of ``gone`` that were not there."""
    g = gone.select(F.lower(F.trim("alias")).alias("alias"), "type", "canonical_id").distinct()
    keys = ["alias", "type", "canonical_id"]
    return aliases.join(g, keys, "left_anti"), g.join(aliases, keys, "left_anti")


def recount(canonicals: DataFrame, aliases: DataFrame) -> DataFrame:
    """Canonical names (id and more) with the number of their aliases."""
    n = aliases.groupBy(F.col("canonical_id").alias("id")).agg(F.count(F.lit(1)).alias("alias_count"))
    return canonicals.drop("alias_count").join(n, "id", "left").withColumn("alias_count", F.coalesce("alias_count", F.lit(0).cast("long")))


def enrichment_candidates(mentions: DataFrame, attempts: DataFrame, now: str, types: tuple[str, ...] = ("person", "org", "place", "event"), least: int = 3, days: int = 30, most: int = 150) -> DataFrame:
    """Names worth looking up: (norm, type, freq, sample) of mentions (norm, type, text, article_id) in enough articles and not tried
    (``attempts``: norm, type, attempted_at) in the last days; the most frequent first, with their most usual spelling."""
    m = mentions.where(F.col("type").isin(*types))
    per = m.groupBy("norm", "type").agg(F.countDistinct("article_id").alias("freq")).where(F.col("freq") >= least)
    spelled = m.groupBy("norm", "type", "text").agg(F.count(F.lit(1)).alias("n")).groupBy("norm", "type").agg(F.min(F.struct((-F.col("n")).alias("n"), "text"))["text"].alias("sample"))
    recent = attempts.where(F.col("attempted_at").cast("timestamp") > F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days))).select("norm", "type")
    return per.join(recent, ["norm", "type"], "left_anti").join(spelled, ["norm", "type"]).orderBy(F.desc("freq"), "norm", "type").limit(most)


def enrich(candidates: DataFrame, found: DataFrame) -> DataFrame:
    """Candidates (norm, type) with what a lookup found (norm, type, title, classes, aliases; a hook outside): ``status`` is
    no_match, type_mismatch, llm_reject (a name of several words whose title is just one of them) or resolved; the canonical
    name of an event goes without its edition, which stays as an alias."""
    from newsloom.functions.query import event_edition, type_fits
    from newsloom.functions.text import squeeze, words

    j = candidates.join(found, ["norm", "type"], "left")
    q, t = (F.array_distinct(words(squeeze(F.lower(F.col(c))))) for c in ("norm", "title"))
    collapsed = (F.size(t) == 1) & (F.size(F.array_except(t, q)) == 0) & (F.size(q) > 1)
    status = F.when(F.coalesce("title", F.lit("")) == "", "no_match").when(~type_fits(F.col("type"), F.col("classes")), "type_mismatch").when(collapsed, "llm_reject").otherwise("resolved")
    e = event_edition(F.col("title"))
    edition = (F.col("type") == "event") & e["edition"].isNotNull()
    known = F.coalesce("aliases", F.array().cast("array<string>"))
    ok = F.col("status") == "resolved"
    return j.withColumn("status", status).select(
        *candidates.columns, "status", F.when(ok, F.when(edition, e["base"]).otherwise(F.col("title"))).alias("canonical"), F.when(ok, F.when(edition, F.concat(known, F.array("title"))).otherwise(known)).alias("aliases")
    )


def upsert_canonicals(canonicals: DataFrame, resolved: DataFrame) -> DataFrame:
    """Canonical names (norm, type, name, source) after looked-up ones (norm, type, canonical): new ones are added, known ones
    take the looked-up name, but an administrator's stay."""
    new = resolved.groupBy("norm", "type").agg(F.min("canonical").alias("canonical"))
    keep = F.col("canonical").isNull() | (F.col("source") == "admin")
    keep = F.coalesce(keep, F.lit(False))
    return canonicals.join(new, ["norm", "type"], "full").select("norm", "type", F.when(keep, F.col("name")).otherwise(F.col("canonical")).alias("name"), F.when(keep, F.col("source")).otherwise("wikidata").alias("source"))


def build_canonicals(mentions: DataFrame, seeds: DataFrame, owned: DataFrame, least: int = 2) -> DataFrame:
    """Aliases (alias, type, canonical, source) of the names that occur in enough articles and have a seed (alias, type,
    canonical): a seed gives way where the canonical name already belongs to a higher authority (``owned``: canonical, type, source)."""
    often = mentions.groupBy(F.col("entity_norm").alias("alias"), F.col("entity_type").alias("type")).agg(F.countDistinct("article_id").alias("articles")).where(F.col("articles") >= least)
    hit = often.join(seeds, ["alias", "type"])
    higher = by_authority(owned.where(F.col("source").isin("admin", "wikidata")), ["canonical", "type"])
    return hit.join(higher, ["canonical", "type"], "left").select("alias", "type", "canonical", F.coalesce("source", F.lit("seed")).alias("source"), "articles")
