"""Clusters: incremental event clustering, leader clustering, votes, merges, demand."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.config import DEFAULT, EngineConfig
from newsloom.functions import vector
from newsloom.functions.text import trigram_similarity


def majority(votes: DataFrame, key: str, value: str, weight: str, share: float = 0.6) -> DataFrame:
    """The value with most weight, if it has the share; ties by the value."""
    w = votes.groupBy(key, value).agg(F.sum(weight).alias("w"))
    by = Window.partitionBy(key)
    s = w.withColumn("share", F.col("w") / F.sum("w").over(by)).withColumn("i", F.row_number().over(by.orderBy(F.desc("w"), value)))
    return s.where("i = 1").select(key, F.when(F.col("share") >= share, F.col(value)).alias(value), "share")


#: Points of a weekly card at most, and their characters; characters of its title and summary; the share that a country needs.
POINTS, POINT_CHARS, TITLE_CHARS, SUMMARY_CHARS, COUNTRY_SHARE = 6, 200, 500, 2000, 0.6


def card_reply(reply: Column) -> Column:
    """A model's reply about a week as (title, summary, key_points, importance): JSON, at times within a fence; null if it can't be read or lacks
    a title or a summary."""
    bare = F.regexp_replace(F.trim(reply), r"(?s)^```(?:json\n|\n)?(.*?)(?:```.*)?$", "$1")
    j = F.from_json(F.trim(bare), "title string, summary string, key_points array<string>, importance string")
    points = F.slice(F.transform(F.filter(F.coalesce(j["key_points"], F.array().cast("array<string>")), lambda p: F.coalesce(p, F.lit("")) != ""), lambda p: F.substring(p, 1, POINT_CHARS)), 1, POINTS)
    said = F.coalesce(j["importance"].try_cast("double"), F.lit(0.0))
    importance = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(said == 0, 0.5).otherwise(said)))
    card = F.struct(F.substring(j["title"], 1, TITLE_CHARS).alias("title"), F.substring(j["summary"], 1, SUMMARY_CHARS).alias("summary"), points.alias("key_points"), importance.alias("importance"))
    return F.when((F.coalesce(j["title"], F.lit("")) != "") & (F.coalesce(j["summary"], F.lit("")) != ""), card)


def weekly_cards(daily: DataFrame, replies: DataFrame, most: int | None = None, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Cards of the largest groups of daily cards: ``daily`` (group, id, article_count, country), ``replies`` (group, reply; what a model said, a hook outside).
    The card with most articles stands for its group, ties by the least id; the country is the one with most articles, if it has the share of those that name one."""
    most = cfg.weekly_top if most is None else most
    size = daily.groupBy("group").agg(F.count(F.lit(1)).alias("cards"), F.max_by("id", F.struct("article_count", (-F.col("id")).alias("k"))).alias("representative"))
    first = size.orderBy(F.desc("cards"), "group").limit(most)
    vote = majority(daily.where("country <> ''").withColumn("w", F.greatest(F.lit(1), F.coalesce("article_count", F.lit(1)))), "group", "country", "w", COUNTRY_SHARE).select("group", "country")
    card = replies.select("group", card_reply(F.col("reply")).alias("card")).where("card is not null")
    return first.join(vote, "group", "left").join(card, "group").select("group", "cards", "representative", "country", "card.*")


def grams_of(title: str) -> set[str]:
    words = "".join(c if c.isalnum() else " " for c in title.lower()).split()
    return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}


class EventFold:
    """Single-pass clustering in order: an article joins the nearest of the five closest live clusters that is near
    enough in meaning and title, else it founds one, whose vector and title stay those of its first article."""

    def __init__(self, cfg: EngineConfig = DEFAULT):
        self.cfg, self.live = cfg, []

    def add(self, article_id, seconds: float, vec, title: str) -> tuple:
        v = np.asarray(vec, float)
        n = np.linalg.norm(v)
        v = v / n if n else v
        self.live = [c for c in self.live if seconds - c["seen"] <= self.cfg.cluster_window_hours * 3600]
        if self.live:
            near = np.round((1 + np.array([c["vec"] for c in self.live]) @ v) / 2, 9)
            grams = grams_of(title)
            for i in sorted(range(len(near)), key=lambda i: (-near[i], self.live[i]["id"]))[:5]:
                c = self.live[i]
                both = len(grams | c["grams"])
                if near[i] >= self.cfg.semantic_threshold and both and len(grams & c["grams"]) / both >= self.cfg.title_threshold:
                    c["seen"] = max(c["seen"], seconds)
                    return c["id"], "matched", float(near[i])
        self.live.append({"id": article_id, "vec": v, "grams": grams_of(title), "title": title, "seen": seconds})
        return article_id, "created", None

    def dump(self) -> tuple:
        """The live clusters as columns, to keep between batches."""
        c = self.live
        return [x["id"] for x in c], [float(x["seen"]) for x in c], [[float(y) for y in x["vec"]] for x in c], [x["title"] for x in c]

    def load(self, state: tuple) -> None:
        self.live = [{"id": i, "seen": s, "vec": np.asarray(v, float), "grams": grams_of(t), "title": t} for i, s, v, t in zip(*state, strict=True)]


#: Rows of a tile, and rows compared at once.
TILE, SLICE = 16_384, 1024
#: Rows that pivots are chosen from at most, and pivots at most (they go to every task).
SAMPLE, PIVOTS = 4096, 512
#: Seats that a placing task hands on at once, and the share of all pairs from which on pivots are not worth their visitors.
SEATS, WORTH = 8192, 0.25
#: Cosines are compared in single precision; what comes this near to a bound is let through to the exact check.
SLACK = 1e-5


def _forest(a: np.ndarray, b: np.ndarray, same: np.ndarray | None, least: float) -> list[tuple[int, int]]:
    """Links (row of a, row of b) of cosine at least ``least`` that hang together what all such links do."""
    n = len(a)
    up, out = np.arange(n + len(b)), []

    def roots_of(at: np.ndarray) -> np.ndarray:
        r = up[at]
        while (over := up[r]).tobytes() != r.tobytes():
            r = over
        up[at] = r
        return r

    for at in range(0, n, SLICE):
        near = a[at : at + SLICE] @ b.T >= least - SLACK
        if same is not None:
            near &= same[0][at : at + SLICE, None] == same[1][None, :]
        for i in np.flatnonzero(near.any(1)):
            found = np.flatnonzero(near[i])
            roots, first = np.unique(roots_of(n + found), return_index=True)
            root = roots_of(np.array([at + i]))[0]
            new = roots != root
            if new.any():
                out += [(at + int(i), int(j)) for j in found[first[new]]]
                up[roots[new]] = root
    return out


def pivots_of(rows: DataFrame, n: int, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """About the root of ``n`` unit vectors, each the one farthest from those before it, from a sample by hash; and the sample."""
    drawn = rows.orderBy(F.xxhash64("vec", "id"), "id").limit(sample).select("vec").collect()
    x = _units([r["vec"] for r in drawn])
    chosen, near = [0], x @ x[0]
    while len(chosen) < min(PIVOTS, round(n**0.5), len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    return x[chosen], x


def _visits(x: np.ndarray, pivots: np.ndarray, twice: float) -> tuple[np.ndarray, np.ndarray]:
    """The home of each row, and for each row the cells it is seated in: its home and those before it that lie within reach."""
    angle = np.arccos(np.clip(x @ pivots.T, -1, 1))
    home = angle.argmin(1)
    goes = angle <= angle[np.arange(len(home)), home][:, None] + twice
    return home, goes & (np.arange(len(pivots))[None, :] <= home[:, None])


def _worth(x: np.ndarray, pivots: np.ndarray, twice: float) -> bool:
    """Whether a sample's rows meet few enough of all pairs by pivots: else plain tiles send far fewer rows."""
    home, goes = _visits(x, pivots, twice)
    at_home = np.bincount(home, minlength=len(pivots))
    return float((at_home * goes.sum(0)).sum()) < WORTH * len(x) ** 2


def _units(vectors) -> np.ndarray:
    v = np.array([np.asarray(x, np.float64) for x in vectors])
    length = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(length > 0, length, 1)


def dealt(rows: DataFrame, least: float, tile: int = TILE) -> DataFrame:
    """Rows (id, vec, block) dealt into cells so that every two rows of one block with a cosine of ``least`` or more meet: (block, cell, a, b, at_home, ...).

    A row's home is its nearest pivot. A row within an angle t of another, whose home is another cell, is at most 2 t farther from
    that cell's pivot than from its own; only such rows visit a cell, and only cells before their own. Visitors are
    compared with those at home. Where a sample shows that this leaves too many pairs (vectors without clusters, a low threshold), all rows are one
    cell. ``vec`` is the unit vector in single precision, as bytes. Cells of more than ``tile`` rows are dealt on, with every tile of those at home meeting every tile.
    """
    n, twice = rows.count(), 2 * np.arccos(min(1.0, max(-1.0, least))) + 1e-6
    pivots, drawn = pivots_of(rows, n) if least > 0 and n else (None, None)
    if pivots is None or not _worth(drawn, pivots, twice):
        return _tiled(rows, tile)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), SLICE):
                pdf = whole.iloc[at : at + SLICE]
                x = _units(pdf.vec)
                home, goes = _visits(x, pivots, twice)
                i, cell = np.nonzero(goes)
                own = _bytes(x)
                for a in range(0, len(i), SEATS):
                    k, c = i[a : a + SEATS], cell[a : a + SEATS]
                    yield pd.DataFrame({"id": pdf.id.to_numpy()[k], "vec": own[k], "block": pdf.block.to_numpy()[k], "cell": c.astype("int32"), "at_home": c == home[k]})

    placed = rows.mapInPandas(place, "id long, vec binary, block string, cell int, at_home boolean")
    sizes = placed.groupBy("block", "cell").agg(F.count(F.lit(1)).alias("n_all"), F.count_if("at_home").alias("n_home"))
    tiles = lambda c: F.ceil(F.col(c) / F.lit(tile)).cast("int")
    sizes = sizes.where("n_home > 0").select("block", "cell", tiles("n_home").alias("across"), tiles("n_all").alias("down"))
    own, every = lambda k: F.array(F.pmod(F.xxhash64("id"), F.col(k)).cast("int")), lambda k: F.sequence(F.lit(0), F.col(k) - 1)
    as_second = F.transform(every("across"), lambda a: _seat(a, own("down")[0], False))
    as_first = F.when(F.col("at_home"), F.transform(every("down"), lambda b: _seat(own("across")[0], b, True))).otherwise(F.array().cast("array<struct<a:int,b:int,first:boolean>>"))
    return placed.join(sizes, ["block", "cell"]).select("block", "cell", "id", "vec", F.inline(F.concat(as_second, as_first)))


def _bytes(x: np.ndarray) -> np.ndarray:
    """Rows in single precision, each as bytes."""
    out = np.empty(len(x), object)
    out[:] = [r.tobytes() for r in x.astype(np.float32)]
    return out


def _seat(a: Column, b: Column, first: bool) -> Column:
    return F.struct(a.alias("a"), b.alias("b"), F.lit(first).alias("first"))


def _tiled(rows: DataFrame, tile: int) -> DataFrame:
    """Every two rows of a block: tiles of about ``tile`` rows, every two of which meet once, and each itself."""

    def unit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf.id, "vec": _bytes(_units(pdf.vec)) if len(pdf) else [], "block": pdf.block})

    n = rows.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("int").alias("tiles"))
    placed = rows.mapInPandas(unit, "id long, vec binary, block string").join(n, "block").withColumn("own", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    as_first = F.transform(F.sequence(F.col("own"), F.col("tiles") - 1), lambda b: _seat(F.col("own"), b, True))
    as_second = F.transform(F.sequence(F.lit(0), F.col("own")), lambda a: _seat(a, F.col("own"), False))
    return placed.select("block", F.lit(0).alias("cell"), "id", "vec", F.inline(F.concat(as_first, as_second)))


def near_components(rows: DataFrame, least: float, tile: int = TILE) -> DataFrame:
    """(id, component): the groups that rows (id, vec, block) of one block form if those of cosine at least ``least``
    are linked, however far apart; the least id of a group names it. Rows that stand alone are left out.

    Exact: equal vectors are one, the others meet by ``dealt``. A task gives a spanning forest of its links, fewer than it has rows, never
    all pairs of a group.
    """
    from newsloom.operators.entities import _cut, propagate

    rows = _cut(rows.where("vec is not null").select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"), F.col("block").cast("string").alias("block")))
    alike = rows.groupBy("vec", "block").agg(F.min("id").alias("first"))
    has_length = F.exists("vec", lambda c: c != 0)
    firsts = _cut(alike.select(F.col("first").alias("id"), "vec", "block"))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        v, ids = np.frombuffer(b"".join(pdf.vec), np.float32).reshape(len(pdf), -1), pdf.id.to_numpy()
        x, y = np.flatnonzero(pdf["first"]), np.flatnonzero(~pdf["first"])
        links = _forest(v[x], v[y], None, least)
        return pd.DataFrame([(ids[x[i]], ids[y[j]]) for i, j in links if ids[x[i]] != ids[y[j]]], columns=["p", "q"]).astype("int64")

    keys, tasks = ["block", "cell", "a", "b"], 4 * rows.sparkSession.sparkContext.defaultParallelism  # tiles are small to send and long to compare
    seats = dealt(firsts.where(has_length) if least > 0 else firsts, least, tile).repartition(tasks, *keys)
    links = seats.groupBy(*keys).applyInPandas(meet, "p long, q long")
    copies = rows.where(has_length) if least > 0 else rows
    copies = copies.join(alike, ["vec", "block"]).where("id <> first").select(F.col("first").alias("p"), F.col("id").alias("q"))
    return propagate(links.unionByName(copies), "p", "q").select(F.col("node").alias("id"), F.col("group").alias("component"))


#: Rows that one task folds at most before a long run is cut into slices of time.
FOLD_ROWS = 100_000


def event_clusters(articles: DataFrame, block: str | None = None, cfg: EngineConfig = DEFAULT, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """(article_id, event_id, action, similarity) of articles (article_id, seconds, vec, title) in order of time and id.

    An article can only join or crowd out a cluster whose first article is near enough in meaning, so the
    order-dependent fold runs apart in each component of such articles; all sources meet. With ``block`` (a
    language, a section) articles of different blocks don't. Articles without a vector are skipped, as rows without an event.
    """

    of = F.coalesce(F.col(block).cast("string"), F.lit("")) if block else F.lit("")
    cols = articles.select(of.alias("block"), F.col("article_id").cast("long").alias("article_id"), F.col("seconds").cast("double").alias("seconds"), F.col("vec").cast("array<double>").alias("vec"), "title")
    near = near_components(cols.select(F.col("article_id").alias("id"), "vec", "block"), 2 * cfg.semantic_threshold - 1)
    placed = cols.where("vec is not null").join(near.withColumnRenamed("id", "article_id"), "article_id", "left").withColumn("component", F.coalesce("component", "article_id"))
    folded = fold_in_slices(placed.select("component", "article_id", "seconds", "vec", "title"), cfg, fold_rows)
    skipped = cols.where("vec is null").select("article_id", F.lit(None).cast("long").alias("event_id"), F.lit("skipped").alias("action"), F.lit(None).cast("double").alias("similarity"))
    return folded.union(skipped)


MADE = "article_id long, event_id long, action string, similarity double"
LIVE = "run string, ids array<long>, seen array<double>, vecs array<array<double>>, titles array<string>"


def fold_in_slices(placed: DataFrame, cfg: EngineConfig = DEFAULT, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """The event fold of each component (component, article_id, seconds, vec, title).

    Where a component is silent for longer than clusters live, nothing is handed on: its runs between such gaps are folded apart.
    Runs of up to ``fold_rows`` rows are folded whole. Longer ones are cut into slices of the time that clusters live, and
    the slices are folded one after the other, all runs at once; the clusters alive at the end of a slice are a written table
    that the next one starts from. So no task folds more than a slice."""
    from functools import reduce

    from newsloom.operators.entities import _cut

    alive = float(cfg.cluster_window_hours * 3600)
    by = Window.partitionBy("component").orderBy("seconds", "article_id")
    gap = F.coalesce((F.col("seconds") - F.lag("seconds").over(by) > alive).cast("int"), F.lit(0))
    placed = _cut(placed.withColumn("row", F.monotonically_increasing_id()))
    times = placed.select("component", "article_id", "seconds", "row").withColumn("gap", gap)
    times = times.withColumn("run", F.concat_ws("/", F.col("component").cast("string"), F.sum("gap").over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("string")))
    sizes = times.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.min("seconds").alias("began"))
    slot = F.when(F.col("n") > fold_rows, F.floor((F.col("seconds") - F.col("began")) / alive)).otherwise(-1).cast("int")
    slots = times.join(sizes, "run").select("row", "run", slot.alias("slot"))
    rows = _cut(placed.join(slots, "row").select("run", "slot", "article_id", "seconds", "vec", "title"))

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by run; one fold is alive at a time."""
        held, f = None, EventFold(cfg)
        for pdf in batches:
            out = []
            for r, a, s, v, t in zip(pdf.run, pdf.article_id, pdf.seconds, pdf.vec, pdf.title, strict=True):
                if r != held:
                    held, f = r, EventFold(cfg)
                out.append((a, *f.add(a, s, v, t or "")))
            yield pd.DataFrame(out, columns=["article_id", "event_id", "action", "similarity"])

    def slice_of(key: tuple, own: pd.DataFrame, live: pd.DataFrame) -> pd.DataFrame:
        f = EventFold(cfg)
        for r in live.itertuples():
            f.load((r.ids, r.seen, r.vecs, r.titles))
        own = own.sort_values(["seconds", "article_id"])
        out = [(key[0], int(a), *f.add(int(a), float(s), v, t or ""), None, None, None, None) for a, s, v, t in zip(own.article_id, own.seconds, own.vec, own.title, strict=True)]
        out.append((key[0], None, None, None, None, *f.dump()))
        return pd.DataFrame(out, columns=["run", "article_id", "event_id", "action", "similarity", "ids", "seen", "vecs", "titles"])

    done = [rows.where("slot < 0").repartition("run").sortWithinPartitions("run", "seconds", "article_id").mapInPandas(whole, MADE)]
    live = rows.sparkSession.createDataFrame([], LIVE)
    for k in range((rows.agg(F.max("slot")).first()[0] or 0) + 1 if not rows.where("slot >= 0").isEmpty() else 0):
        told = _cut(rows.where(F.col("slot") == k).groupBy("run").cogroup(live.groupBy("run")).applyInPandas(slice_of, f"run string, {MADE}, {LIVE.partition(', ')[2]}"))
        done.append(told.where("article_id is not null").select("article_id", "event_id", "action", "similarity"))
        live = told.where("ids is not null").select("run", "ids", "seen", "vecs", "titles")
    return reduce(DataFrame.unionByName, done)


class LeaderFold:
    """Cards in order: one joins the first leader it is like, else it leads. Cards without a vector lead and are followed by none."""

    def __init__(self, least: float):
        self.least, self.ids, self.n = least, [], 0

    def add(self, card, vec) -> int:
        if vec is None:
            return card
        v = np.asarray(vec, float)
        length = np.linalg.norm(v)
        v = v / length if length else v
        if self.n:
            found = np.flatnonzero(self.vecs[: self.n] @ v >= self.least)
            if len(found):
                return self.ids[found[0]]
            if self.n == len(self.vecs):
                self.vecs = np.r_[self.vecs, np.empty_like(self.vecs)]
        else:
            self.vecs = np.empty((16, len(v)))
        self.vecs[self.n] = v
        self.n += 1
        self.ids.append(card)
        return card


def leader_clusters(cards: DataFrame, least: float) -> DataFrame:
    """Greedy leaders of all cards (id, place, vec) in order of ``place``: a card leads if no earlier leader is like it
    (cosine at least ``least``), else it joins the first such leader; (id, leader). The order only matters within
    a component of near cards, so each is folded apart and no card is left open."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by component; one fold is alive at a time."""
        held, f = None, LeaderFold(least)
        for pdf in batches:
            rows = []
            for b, i, v in zip(pdf.component, pdf.id, pdf.vec, strict=True):
                if b != held:
                    held, f = b, LeaderFold(least)
                rows.append((i, f.add(i, v)))
            yield pd.DataFrame(rows, columns=["id", "leader"])

    near = near_components(cards.select("id", "vec", F.lit("").alias("block")), least)
    placed = cards.select(F.col("id").cast("long").alias("id"), "place", "vec").join(near, "id", "left").withColumn("component", F.coalesce("component", "id"))
    return placed.repartition("component").sortWithinPartitions("component", "place", "id").mapInPandas(run, "id long, leader long")


def merge(members: DataFrame, moves: DataFrame) -> DataFrame:
    """Move memberships (cluster, item, role) of each ``source`` to its ``target``; where both hold an item one stays,
    primary if either was. Moves to itself are none."""
    m = moves.where("source <> target")
    j = members.join(m, members["cluster"] == m["source"], "left").select(F.coalesce("target", "cluster").alias("cluster"), "item", "role")
    return j.groupBy("cluster", "item").agg(F.min("role").alias("role"))  # 'primary' sorts before 'secondary'


def merge_target(clusters: DataFrame, group: str) -> DataFrame:
    """Of clusters that drifted together the most used stays, then the oldest, then the least id."""
    by = Window.partitionBy(group).orderBy(F.desc(F.col("subscriptions") + F.col("artifacts")), "created_at", "id")
    return clusters.select(group, F.col("id").alias("source"), F.first("id").over(by).alias("target"))


def nearest_centroid(items: DataFrame, centroids: DataFrame, least: float) -> DataFrame:
    """Each item's most similar centroid, if similar enough; never a new one. Centroids go to every task only if they are
    counted few; the best of a task's centroids is found before anything is shuffled."""
    from newsloom.operators.retrieval import meet

    pairs = meet(centroids.select("cluster", "centroid"), items.select("id", "vec"))
    s = pairs.select("id", F.struct(F.round(vector.cosine(F.col("vec"), F.col("centroid")), 6).alias("cos"), (-F.col("cluster")).alias("k")).alias("x"))
    best = s.groupBy("id").agg(F.max("x").alias("x"))
    return best.select("id", (-F.col("x.k")).alias("cluster"), F.col("x.cos").alias("cos")).where(F.col("cos") >= least)


def titles_alike(a, b, cfg: EngineConfig = DEFAULT):
    return trigram_similarity(a, b) >= cfg.title_threshold
