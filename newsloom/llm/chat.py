"""Chat formatting in budgeted windows, with DataFrame functions alone.

The template writes a turn as ``### role``, its text and ``</turn>``. Within roles and texts the characters
that control strings start with are escaped (``\\`` as ``\\b``, ``#`` as ``\\h``, ``<`` as ``\\l``), so no text
can hold a control string, and undoing it gives the text back.

A conversation is cut into windows at turns. With the running sum of its turns' tokens, a turn belongs to the
stretch of ``budget - history - system`` tokens that its end lies in; a turn longer than ``history`` tokens is
a span of its own. A window holds the conversation's system turn, then as many whole turns before its span
as fit in ``history`` tokens and in what the budget has left, then the span. Loss is taken on the assistant
turns of the span only: repeated turns are masked, so each assistant text is a target once.

A window is over the budget only if a single turn is too long to fit beside the system turn. Running sums
are built from blocks of turns and the sums of whole blocks, so a conversation of any length is dealt out; only
a window's own turns, which the budget bounds, meet in one task.

Null texts and roles are empty. Turns come by (turn, role, text), null turns first; repeated rows are turns of
their own. Texts may be of any length: a turn longer than the budget is a window of its own. An empty table gives no windows. Further
columns, whatever their names, are not read. Rows without a conv_id are one conversation. The system turn is the first turn, if its role is ``system``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

HEAD, BREAK, END = "### ", "\n", "</turn>\n"
BUDGET, HISTORY = 1024, 192
#: Turn numbers that share a block, blocks that share a group.
BLOCK, GROUP = 64, 1024


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("#"), F.lit("\\h")), F.lit("<"), F.lit("\\l"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\h"), F.lit("#")), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(HEAD), escape(role), F.lit(BREAK), escape(text), F.lit(END))


def token_estimate(text: Column) -> Column:
    """A token for every four characters begun, and four for the turn's marks."""
    return F.ceil(F.length(text) / 4.0).cast("long") + 4


CONV, AT, OVER = ["key", "null_id"], ["block", "by_role", "by_text"], ["over", "by_role", "over_text"]


def numbered(turns: DataFrame, tokens) -> tuple[DataFrame, DataFrame]:
    """Turns with their place in the conversation (``pos``), running sums (``upto`` of tokens, the turn included), the tokens of the
    system turn and the number of all turns; and the blocks that they were numbered by, with the system turn's text.

    Sums are taken within a block of turn numbers (null ones are dealt by role and the text's beginning), over the blocks before it
    in a group of blocks, and over the groups before that: no task holds a conversation, but one row for ``BLOCK * GROUP`` turns of it."""
    null, first_chars = F.col("turn").isNull(), lambda n: F.when(F.col("turn").isNull(), F.substring("text", 1, n)).otherwise("")
    t = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    t = t.withColumn("tokens", tokens(F.col("text"))).withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 60))).cast("long"))
    t = t.withColumn("by_role", F.when(null, F.col("role")).otherwise("")).withColumn("by_text", first_chars(8))
    t = t.withColumn("key", F.coalesce("conv_id", F.lit(-(1 << 62)))).withColumn("null_id", F.col("conv_id").isNull())
    own = Window.partitionBy(*CONV, *AT).orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    t = staged(t.withColumn("upto", F.sum("tokens").over(own)).withColumn("pos", F.count(F.lit(1)).over(own)))

    led = F.struct(F.when(F.col("role") == "system", F.col("tokens")).alias("tokens"), F.when(F.col("role") == "system", F.col("text")).alias("text"))
    sums = t.groupBy(*CONV, *AT).agg(F.max("upto").alias("n_tokens"), F.max("pos").alias("n_turns"), F.min_by(led, "pos").alias("led"))
    sums = staged(sums.withColumn("over", F.floor(F.col("block") / GROUP)).withColumn("over_text", F.substring("by_text", 1, 2)))
    groups = sums.groupBy(*CONV, *OVER).agg(F.sum("n_tokens").alias("g_tokens"), F.sum("n_turns").alias("g_turns"), F.min_by("led", F.struct(*AT)).alias("g_led"))
    whole = Window.partitionBy(*CONV).orderBy(*OVER).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = Window.partitionBy(*CONV).orderBy(*OVER).rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(*CONV, *OVER, F.sum("g_turns").over(whole).alias("turns_in_all"), F.first("g_led").over(whole).alias("system"), *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("g_tokens", "g_turns")))
    before = Window.partitionBy(*CONV, *OVER).orderBy(*AT).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*CONV, *AT, *OVER[::2], *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n_tokens", "n_turns")))
    blocks = sums.join(groups, [*CONV, *OVER]).select(
        *CONV, *AT, (F.col("n_tokens_before") + F.col("g_tokens_before")).alias("tokens_before"), (F.col("n_turns_before") + F.col("g_turns_before")).alias("turns_before"),
        "turns_in_all", F.col("system.tokens").alias("system_tokens"), F.col("system.text").alias("system_text"),
    )
    blocks = staged(blocks)
    placed = t.join(blocks.drop("system_text"), [*CONV, *AT])
    upto, pos = (F.col("upto") + F.col("tokens_before")).alias("upto"), (F.col("pos") + F.col("turns_before") - 1).alias("pos")
    return placed.select("conv_id", *CONV, *AT, "role", "text", "tokens", upto, pos, "system_tokens", "turns_in_all"), blocks


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens=token_estimate) -> DataFrame:
    """The windows of all conversations: conv_id, window (the place of its first new turn, which orders a
    conversation's windows), formatted, n_system, n_history, n_new (turns of each kind, in this order) and
    loss (code-point spans in ``formatted``)."""
    t, blocks = numbered(turns, tokens)
    t, conv = staged(t), CONV
    head = F.coalesce("system_tokens", F.lit(0))
    is_system = (F.col("pos") == 0) & F.col("system_tokens").isNotNull()
    stride = F.greatest(F.lit(budget - history) - head, F.lit(1))
    t = t.withColumn("stride", stride).withColumn("alone", (F.col("tokens") > history) & ~is_system).withColumn("start", F.col("upto") - F.col("tokens"))
    # the system turn takes no room in the running sums that cut the spans
    t = t.withColumn("shift", head).withColumn("cell", F.when(is_system, F.lit(0)).otherwise(F.floor((F.col("upto") - F.col("shift") - 1) / F.col("stride"))).cast("long"))

    # a span is a run of turns of one cell without a long turn inside; a cell's turns are few, so one task may order them
    within = Window.partitionBy(*conv, "cell").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    longs = F.sum(F.col("alone").cast("long")).over(within)
    new = t.where(~is_system).withColumn("part", 2 * longs - F.col("alone").cast("long"))
    only = t.where(is_system)
    spans = new.groupBy(*conv, "cell", "part").agg(F.min("pos").alias("window"), F.min("start").alias("begin"), F.sum("tokens").alias("fresh"), F.first("system_tokens").alias("system_tokens"), F.min_by(F.struct("conv_id", *AT), "pos").alias("at"))
    room = F.greatest(F.least(F.lit(history), F.lit(budget) - F.col("fresh") - F.coalesce("system_tokens", F.lit(0))), F.lit(0))
    spans = spans.withColumn("room", room)
    placed = new.join(spans.select(*conv, "cell", "part", "window"), [*conv, "cell", "part"]).select("conv_id", *conv, "window", F.lit(2).alias("kind"), "pos", "role", "text")

    # history: turns that start at most `room` tokens before the span; they end in one of the cells before it that `room` reaches
    reach = spans.alias("s").select(*conv, F.col("window").alias("w"), "begin", "room", F.coalesce("system_tokens", F.lit(0)).alias("shift_"))
    unit = F.lit(max(1, history))
    reach = reach.withColumn("slot", F.explode(F.sequence(F.floor((F.col("begin") - F.col("room")) / unit), F.floor(F.col("begin") / unit))))
    past = new.select("conv_id", *conv, "pos", "role", "text", "start", "upto", F.floor(F.col("start") / unit).alias("slot"))
    repeated = past.join(reach, [*conv, "slot"]).where("start >= begin - room and upto <= begin and pos < w")
    repeated = repeated.select("conv_id", *conv, F.col("w").alias("window"), F.lit(1).alias("kind"), "pos", "role", "text")

    # the system turn heads every window; a conversation of a system turn alone is one window
    led = spans.where("system_tokens is not null").select(*conv, "window", "at.*")
    texts = blocks.where("system_tokens is not null").select(*conv, *AT, F.col("system_text").alias("text"))
    heads = led.join(texts, [*conv, *AT]).select("conv_id", *conv, "window", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("pos"), F.lit("system").alias("role"), "text")
    lone = only.where("turns_in_all = 1").select("conv_id", *conv, F.lit(0).cast("long").alias("window"), F.lit(0).alias("kind"), "pos", "role", "text")
    rows = placed.unionByName(repeated).unionByName(heads).unionByName(lone)

    turn = F.struct("kind", "pos", rendered(F.col("role"), F.col("text")).alias("body"), F.length(escape(F.col("role"))).alias("name"), (F.col("role") == "assistant").alias("target"))
    grouped = rows.groupBy("conv_id", *conv, "window").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    ends = F.aggregate(
        "turns",
        F.array().cast("array<struct<end:bigint,start:bigint,stop:bigint>>"),
        lambda done, x: F.concat(done, F.array(_span(F.coalesce(F.try_element_at(done, F.lit(-1))["end"], F.lit(0)).cast("long"), x))),
    )
    kinds = lambda k: F.size(F.filter("turns", lambda x: x["kind"] == k)).cast("long")
    out = grouped.withColumn("ends", ends)
    return out.select(
        "conv_id",
        "window",
        F.array_join(F.transform("turns", lambda x: x["body"]), "").alias("formatted"),
        kinds(0).alias("n_system"),
        kinds(1).alias("n_history"),
        kinds(2).alias("n_new"),
        F.transform(F.filter("ends", lambda e: e["start"] >= 0), lambda e: F.struct(e["start"].alias("start"), e["stop"].alias("stop"))).alias("loss"),
    )


def _span(at: Column, turn: Column) -> Column:
    """Where a turn ends, and where its text lies if it is a target."""
    end = at + F.length(turn["body"])
    first = at + len(HEAD) + turn["name"] + len(BREAK)
    wanted = turn["target"] & (turn["kind"] == 2)
    return F.struct(
        end.cast("long").alias("end"),
        F.when(wanted, first).otherwise(F.lit(-1)).cast("long").alias("start"),
        F.when(wanted, end - len(END)).otherwise(F.lit(-1)).cast("long").alias("stop"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Each window's new turns and loss text, parsed from its formatted text: conv_id, window, turns (array of
    role, text), loss_text (array), formatted_chars. The first window also gives the system turn."""
    bodies = F.filter(F.split("formatted", END), lambda x: x != "")

    def parsed(x: Column) -> Column:
        at = F.instr(x, BREAK)
        return F.struct(
            unescape(F.substring(x, F.lit(len(HEAD) + 1), at - len(HEAD) - 1)).alias("role"),
            unescape(F.substring(x, at + len(BREAK), F.length(x))).alias("text"),
        )

    f = formatted.withColumn("bodies", bodies)
    skipped = (F.col("n_system") + F.col("n_history")).cast("int")
    fresh = F.slice("bodies", skipped + 1, F.greatest(F.col("n_new").cast("int"), F.lit(0)))
    f = f.withColumn("with_system", (F.col("n_system") > 0) & (F.col("window") <= 1))  # the turn after the system turn is at 1
    own = F.concat(F.when(F.col("with_system"), F.slice("bodies", 1, 1)).otherwise(F.array().cast("array<string>")), fresh)
    loss = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int"))))
    return f.select("conv_id", "window", F.transform(own, parsed).alias("turns"), loss.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))
