"""Event ids that outlive regrouping: a registry of notices and an alias table of retired ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import discard, stored

PREFIX = "evt_"
MAX_ROUNDS = 64


def resolved(aliases: DataFrame) -> DataFrame:
    """aliases(old, live) with every chain followed to its end: each round every alias jumps over the one it points to, so a chain of n takes log n rounds.

    Of several aliases of one id the smallest counts. A cycle raises.
    """
    links = stored(aliases.where("old <> live").groupBy("old").agg(F.min("live").alias("live")), "aliases")
    for _ in range(MAX_ROUNDS):
        further = links.select(F.col("old").alias("live"), F.col("live").alias("further"))
        jumped = stored(links.join(further, "live", "left").select("old", F.coalesce("further", "live").alias("live"), F.col("further").isNotNull().alias("moved")), "aliases")
        if jumped.where("old = live").limit(1).count():
            raise ValueError("aliases form a cycle")
        moved = jumped.where("moved").limit(1).count()
        discard(links)
        links = jumped.drop("moved")
        if not moved:
            return links
    raise RuntimeError(f"aliases did not settle in {MAX_ROUNDS} rounds")


def registered(groups: DataFrame, registry: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(registry, aliases) after a grouping: groups(id, first_seen, grp), registry(id, event), aliases(old, live).

    A group keeps the event id of its oldest registered member, else it is named after its oldest member. Ids of events that were merged into it become aliases of it, and every
    retired id leads to a live one, however often events were merged. Notices that are in no group any more keep their entry, led on to the live id. Null first_seen comes last.
    """
    ends = resolved(aliases)
    live = lambda frame, name: frame.join(ends.select(F.col("old").alias(name), F.col("live").alias("to")), name, "left").withColumn(name, F.coalesce("to", name)).drop("to")
    known = live(registry, "event")
    birth = F.struct(F.col("first_seen").isNull().alias("unseen"), "first_seen", "id")
    members = groups.join(known, "id", "left").withColumn("birth", birth)
    named = members.groupBy("grp").agg(F.min_by("event", F.when(F.col("event").isNotNull(), F.col("birth"))).alias("kept"), F.min("birth")["id"].alias("first"))
    named = named.select("grp", F.coalesce("kept", F.concat(F.lit(PREFIX), F.col("first").cast("string"))).alias("named"))
    mine = stored(members.join(named, "grp").select("id", "event", "named"), "registered")
    retired = mine.where("event <> named").select(F.col("event").alias("old"), F.col("named").alias("live")).distinct()
    after = stored(resolved(ends.unionByName(retired)), "aliases-live")
    ends = after
    gone = live(known.join(mine, "id", "left_anti"), "event")
    return live(mine.select("id", F.col("named").alias("event")), "event").unionByName(gone), after
