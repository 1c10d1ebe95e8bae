"""Corrections of dates by hand: each with its evidence, applied over the automatic reading, which stays beside them and can be taken back.

items: id, url, detail_checked_at, the four fields of `CORRECTED` (texts), the six of `KEPT_BESIDE` (two flags, four texts), and two structs, null where nothing is corrected:
`automatic` (the ten fields before) and `manual_correction`. More columns pass through.
entries: place (order in the file), url, evidence_url, checked_at, reason and fields, a map of what is set; a field that is set to null is in the map with null.
tracking: key (notice and entry), automatic_signature, first_applied_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from ..functions import timing as M
from ..functions import urls as U
from ..functions.canonical import content_hash
from ..workspace import stored

FLAGS = ("registration_ambiguous", "registration_time_ambiguous")
BACKUP = P.CORRECTED + P.KEPT_BESIDE
AUTOMATIC = "struct<" + ",".join(f"{name}:{'boolean' if name in FLAGS else 'string'}" for name in BACKUP) + ">"
MANUAL = "struct<evidence_url:string,checked_at:string,reason:string,needs_review:boolean>"
ENTRIES = "place int, url string, evidence_url string, checked_at string, reason string, fields map<string,string>"
TRACKING = "key string, automatic_signature string, first_applied_at string"
_TEXTS = T.MapType(T.StringType(), T.StringType())


def judged_entries(entries: DataFrame, today: Column) -> DataFrame:
    """entries with their canonical addresses, day and reason, and `broken`: the names of the rules that each breaks, in order; a sound one has its `digest`.

    url, evidence_url: no address; checked_at: no day, or one after today; reason: none; nothing: no field is set; unknown: a field that cannot be set; then the fields that are neither null nor a day or a clock.
    """
    text = lambda name: F.coalesce(name, F.lit(""))
    target, evidence = (U.canonical_url(text(name)) for name in ("url", "evidence_url"))
    day, reason = F.left(text("checked_at"), F.lit(10)), F.left(F.regexp_replace(text("reason"), r"(?U)^\s+|\s+$", ""), F.lit(P.MAX_REASON))
    fields = F.coalesce("fields", F.create_map().cast("map<string,string>"))
    names = F.map_keys(fields)
    given = lambda name: F.try_element_at(fields, F.lit(name))
    rules = {
        "url": target == "", "evidence_url": evidence == "", "checked_at": F.coalesce(M.valid_day(day) > today, F.lit(True)), "reason": reason == "",
        "nothing": F.size(names) == 0, "unknown": F.size(F.array_except(names, F.array(*[F.lit(n) for n in P.CORRECTED]))) > 0,
    }
    for name in P.CORRECTED:
        valid = M.clock_minutes(given(name)) if name.endswith("_time") else M.valid_day(given(name))
        rules[name] = given(name).isNotNull() & valid.isNull()
    broken = F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules.items()]))
    literal = lambda *names: [x for name, value in names for x in (F.lit(name), value)]
    whole = F.map_concat(fields, F.create_map(*literal(("evidence_url", evidence), ("checked_at", day), ("reason", reason))))
    digest = F.when(F.size(broken) == 0, content_hash(whole, _TEXTS))
    return entries.select("place", target.alias("url"), evidence.alias("evidence_url"), day.alias("checked_at"), reason.alias("reason"), fields.alias("fields"), broken.alias("broken"), digest.alias("digest"))


def restored(items: DataFrame) -> DataFrame:
    """items with their automatic dates, as if no correction had been made."""
    back = {name: F.when(F.col("automatic").isNotNull(), F.col(f"automatic.{name}")).otherwise(F.col(name)) for name in BACKUP}
    return items.withColumns(back | {"automatic": F.lit(None).cast(AUTOMATIC), "manual_correction": F.lit(None).cast(MANUAL)})


def _target(url: Column) -> Column:
    """The canonical address of a notice, never null: a join by it then needs no test for null, for which it would be worked out a second time."""
    return F.coalesce(U.canonical_url(F.coalesce(url, F.lit(""))), F.lit(""))


def _combined(name: str) -> Column:
    """What a field is after an entry: its own value or the entry's; a clock goes with the day that it belonged to."""
    entry, item = F.col("entry.fields"), F.col(name)
    value = F.when(F.map_contains_key(entry, name), F.try_element_at(entry, F.lit(name))).otherwise(item)
    if name.endswith("_time"):
        day = name.removesuffix("_time")
        moved = F.map_contains_key(entry, day) & ~F.try_element_at(entry, F.lit(day)).eqNullSafe(F.col(day))
        value = F.when(moved & ~F.map_contains_key(entry, name), None).otherwise(value)
    return value


def patched(items: DataFrame, entries: DataFrame, tracking: DataFrame, now: str) -> DataFrame:
    """The notices of restored items that an entry (judged, one an address) corrects, with the entry's evidence, `new` fields, `broken`, `signature`, `old`: its row in tracking so far, null where there is none, and `tracked`: the row that it has from now on.

    broken: clock_alone (a clock without its day), order (a start day after the last day), clock_order (a start instant after the last instant).
    """
    hit = items.withColumn("target", _target(F.col("url"))).join(F.broadcast(entries.select(F.col("url").alias("target"), F.struct("evidence_url", "checked_at", "reason", "fields", "digest").alias("entry"))), "target")  # at most MAX_CORRECTIONS rows
    before = T.StructType([T.StructField(name, T.StringType()) for name in P.CORRECTED])
    keyed = hit.withColumns({"key": F.concat_ws(":", F.col("id").cast("string"), "entry.digest"), "signature": content_hash(F.struct(*P.CORRECTED), before)})
    known = keyed.join(tracking.select("key", F.struct("automatic_signature", "first_applied_at").alias("old")), "key", "left")
    # what follows from an item and its entry is worked out behind the exchange, which carries the items alone
    new = known.withColumn("new", F.struct(*[_combined(name).alias(name) for name in P.CORRECTED]))
    said = lambda name: F.coalesce(F.col(f"new.{name}"), F.lit("")) != ""
    instant = lambda day: M.exact_instant(M.valid_day(F.col(f"new.{day}")), F.col(f"new.{day}_time"), F.lit(False))
    rules = {
        "clock_alone": (said("deadline_time") & ~said("deadline")) | (said("registration_start_time") & ~said("registration_start")),
        "order": said("registration_start") & said("deadline") & (F.col("new.registration_start") > F.col("new.deadline")),
        "clock_order": F.coalesce(instant("registration_start") > instant("deadline"), F.lit(False)),
    }
    return new.withColumns({
        "broken": F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()])),
        "tracked": F.struct("key", F.coalesce("old.automatic_signature", "signature").alias("automatic_signature"), F.coalesce("old.first_applied_at", F.lit(now)).alias("first_applied_at")),
        "entry": F.col("entry").dropFields("fields", "digest"),
    }).drop("key", "target")


def corrected(items: DataFrame, entries: DataFrame, tracking: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(items, tracking) after the entries, at an instant `now` (ISO text). Former corrections are taken back first, so applying twice changes nothing.

    Of several entries for one address the last counts. A broken entry, too many of them, or one that breaks a notice refuses the whole (ValueError), before anything is given.
    A correction needs review where the automatic reading differs from what it was when the correction was first applied, and is no older than it. Notices that nothing corrects are neither shuffled nor
    joined with tracking; corrected ones meet tracking by key. Null addresses match nothing; ids are given as they are, tracking keys hold them as text.
    """
    nth = F.row_number().over(Window.partitionBy("url").orderBy(F.desc("place"), F.desc("checked_at"), "reason"))
    told = stored(judged_entries(entries, F.lit(now[:10]).cast("date")).limit(P.MAX_CORRECTIONS + 1).withColumn("nth", nth), "corrections")
    if told.count() > P.MAX_CORRECTIONS:
        raise ValueError(f"at most {P.MAX_CORRECTIONS} corrections are taken")
    wrong = told.where("size(broken) > 0").select("place", "broken").orderBy("place").limit(5).collect()
    if wrong:
        raise ValueError("broken corrections: " + "; ".join(f"{r['place']}: {', '.join(r['broken'])}" for r in wrong))
    last = told.where("nth = 1")
    plain = restored(items)
    hit = stored(patched(plain, last, tracking, now), "corrected")
    wrong = hit.where("size(broken) > 0").select("id", "broken").limit(5).collect()
    if wrong:
        raise ValueError("corrections that break notices: " + "; ".join(f"{r['id']}: {', '.join(r['broken'])}" for r in wrong))
    review = (F.col("tracked.automatic_signature") != F.col("signature")) & (F.left(F.coalesce("detail_checked_at", F.lit("")), F.lit(10)) >= F.col("entry.checked_at"))
    values = {
        "automatic": F.struct(*[F.col(name).cast("boolean" if name in FLAGS else "string").alias(name) for name in BACKUP]), "registration_ambiguous": F.lit(False), "registration_time_ambiguous": F.lit(False),
        "manual_correction": F.struct("entry.evidence_url", "entry.checked_at", "entry.reason", review.alias("needs_review")), "date_source_url": F.col("entry.evidence_url"), "date_evidence": F.col("entry.reason"),
        "date_note": F.concat(F.lit(P.CORRECTION_NOTE), F.when(review, P.CORRECTION_REVIEW).otherwise("")), "date_status": F.lit("manual"),
    } | {name: F.col(f"new.{name}") for name in P.CORRECTED}
    done = hit.select(*[values[name].alias(name) if name in values else F.col(name) for name in plain.columns])
    addresses = F.broadcast(last.select(F.col("url").alias("target")))  # at most MAX_CORRECTIONS rows
    others = plain.join(addresses, _target(plain["url"]) == F.col("target"), "left_anti")
    fresh = hit.where("old is null").select("tracked.*").dropDuplicates(["key"])
    return others.unionByName(done), tracking.select("key", "automatic_signature", "first_applied_at").unionByName(fresh)
