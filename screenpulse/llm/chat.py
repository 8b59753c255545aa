"""Chat formatting: logged snapshots of a growing conversation collapse to the longest one, which is rendered.

Each conversation is its turns in order.  A rolling hash covers each prefix: every turn, with its place, has a SHA-256
digest, and a prefix is the exclusive or of its turns' digests, told in four lanes of 64 bits - one running aggregate
over the turns, however many they are.  A conversation whose whole hash is a proper prefix hash of another goes
(anti-join), and so do later copies of a whole conversation; what stays is maximal.  Prefix hashes are made distinct
before the join, so a first turn that a third of all conversations share is one row there.

Turns stay rows until the maximal conversations are known; only those are gathered, each to its own rendered text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: How a turn is rendered, and what follows a conversation.
TURN = ("<|", "|>\n", "\n")
END = "<|end|>"
LANES = tuple(f"h{i}" for i in range(4))


def _lanes(place: Column) -> list[Column]:
    """The digest of a turn at a place, in lanes; lengths keep role and text apart, and null from empty."""
    part = lambda c: F.concat(F.coalesce(F.length(c).cast("string"), F.lit("null")), F.lit(":"), F.coalesce(c, F.lit("")))
    digest = F.sha2(F.concat_ws("|", place.cast("string"), part(F.col("role")), part(F.col("text"))), 256)
    return [F.xxhash64(digest, F.lit(i)) for i in range(len(LANES))]


def prefixes(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, place (from 1), role, text, h0..h3 (of the turns so far), last (whether the conversation ends here).

    A turn without a conversation is one by itself: that key could hold any number of rows.  Equal ones are one.
    """
    one = turns.select(turns[conv_col].alias("conv_id"), turns[turn_col].alias("turn"), turns[role_col].alias("role"), turns[text_col].alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = one.where("conv_id is not null").select("conv_id", F.row_number().over(order).alias("place"), "turn", "role", "text", F.lead(F.lit(1)).over(order).isNull().alias("last"))
    hashed = placed.select("*", *[c.alias(f"d{i}") for i, c in enumerate(_lanes(F.col("place")))])
    sofar = order.rowsBetween(Window.unboundedPreceding, 0)
    told = hashed.select("conv_id", "place", "role", "text", *[F.bit_xor(f"d{i}").over(sofar).alias(h) for i, h in enumerate(LANES)], "last")
    alone = one.where("conv_id is null").select("conv_id", "role", "text").distinct()
    alone = alone.select("conv_id", F.lit(1).alias("place"), "role", "text", *[c.alias(h) for c, h in zip(_lanes(F.lit(1)), LANES, strict=True)], F.lit(True).alias("last"))
    return told.unionByName(alone)


def render(role: Column, text: Column) -> Column:
    a, b, c = TURN
    return F.concat(F.lit(a), F.coalesce(role, F.lit("user")), F.lit(b), F.coalesce(text, F.lit("")), F.lit(c))


def collapse(turns: DataFrame, **columns) -> DataFrame:
    """conv_id, n_turns, rendered: the maximal conversations.

    Of equal conversations the one with the least id stays (null last).  Turns are ordered by turn, then role and
    text; repeated turn rows are turns.  A null role or text is its own value when compared; rendered it is "user"
    or empty.  Each turn without a conversation id is a conversation of its own.  Empty in, empty out.
    """
    told = saved(prefixes(turns, **columns), "turns")
    inner = told.where(~F.col("last")).select(*[F.col(h).alias(f"p_{h}") for h in LANES]).distinct()
    whole = told.where("last").groupBy(*LANES).agg(F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id")).alias("first"))
    stays = whole.join(inner, [whole[h] == inner[f"p_{h}"] for h in LANES], "left_anti")
    each = F.struct("place", render(F.col("role"), F.col("text")).alias("turn"))
    text = lambda some: F.concat(F.array_join(F.transform(F.array_sort(some), lambda t: t["turn"]), ""), F.lit(END))
    named = stays.where("not first.none").select(F.col("first.conv_id").alias("s"))
    kept = told.join(named, told["conv_id"] == named["s"], "left_semi").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.collect_list(each).alias("turns"))
    # Of conversations without an id, the turn's own hash is the whole one.
    alone = told.where("conv_id is null").join(stays.where("first.none").select(*LANES), list(LANES), "left_semi")
    alone = alone.select("conv_id", F.lit(1).cast("long").alias("n_turns"), F.array(each).alias("turns"))
    return kept.unionByName(alone).select("conv_id", "n_turns", text(F.col("turns")).alias("rendered"))
