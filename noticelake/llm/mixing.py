"""Mixing sources to target token counts by entropy balancing.

The rates of a source's documents solve

    minimise  sum_i w_i ln w_i - w_i   subject to  sum_i size_i w_i = target,  0 <= w_i <= 2,

whose solution is the exponential tilt w_i = min(2, exp(lambda * size_i / scale)) with one multiplier
for each source. The multipliers are found by safeguarded Newton steps on the convex dual; every step
is one Spark aggregation over (source, size) cells, which hold all that the sums need. Rates become
copies by diffusing the rounding error over the cells of a source from long to short documents, and
inside a cell the documents with the smallest hashes take the extra copy.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and share 150 % of all
sizes; a target stops at twice its source's size and the excess goes to the others by weight. That
fixed point is min(2 * size, level * weight), found from one running sum over the sources.

Defined cases: null or blank texts have size 0 and keep one copy; a source of size 0 has target 0;
equal rows are interchangeable; texts of any length count whole; ties of the hash of id and text are
equal rows; other columns are carried whatever their names, but `mix` replaces those named like its
results; an empty table gives an empty result; rates that do not settle raise; reruns agree because
rates are rounded to millionths before copies are counted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import stored
from .columns import Shield

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CAP = 1.5, 2.0
RATE_UNIT = 1_000_000
MAX_STEPS, TOLERANCE = 100, 1e-10
_MASK63 = (1 << 63) - 1
RESULTS = ["size", "source_size", "target", "copies", "taken"]


def word_count(text: Column) -> Column:
    """Maximal runs of characters outside [\\x20\\x09-\\x0D]."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """sizes(source, source_size, ...) with target. One row a source, so a single ordered window is small."""
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    ordered = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))))
    weighed = ordered.select(*sizes.columns, F.element_at(weights, ((F.col("place") - 1) % len(WEIGHTS) + 1).cast("int")).alias("weight"), "place")
    by_ratio = Window.orderBy("ratio", "place")
    everyone = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    full = F.col("source_size") * CAP
    leveled = weighed.withColumn("ratio", full / F.col("weight")).withColumns({
        "all_size": F.sum("source_size").over(everyone),
        "capped": F.coalesce(F.sum(full).over(earlier), F.lit(0.0)),
        "open_weight": F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    }).withColumn("level", (SHARE * F.col("all_size") - F.col("capped")) / F.col("open_weight"))
    # the first source, by ratio, whose level lies below its ratio fixes the level of all
    fixed = leveled.withColumn("final", F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(everyone))
    return fixed.select(*sizes.columns, F.when(F.col("final").isNull(), full).otherwise(F.least(full, F.col("final") * F.col("weight"))).cast("double").alias("target"))


def _tilt(rate_of: Column) -> Column:
    return F.least(F.lit(CAP), F.exp(F.least(F.lit(5.0), rate_of)))


def solve(cells: DataFrame) -> DataFrame:
    """cells(source, size, docs) -> (source, source_size, target, scale, lam). lam is null where every rate is the cap."""
    sums = cells.groupBy("source").agg(
        F.sum(F.col("docs") * F.col("size")).alias("source_size"),
        (F.sum(F.col("docs") * F.col("size") * F.col("size")) / F.greatest(F.lit(1), F.sum(F.col("docs") * F.col("size")))).alias("scale"),
    )
    state = stored(targets(sums).withColumns({
        "lam": F.lit(0.0), "low": F.lit(-1e7), "high": F.lit(1e7), "off": F.lit(1.0),
    }), "mix-state")
    open_source = (F.col("target") > 0) & (F.col("target") < CAP * F.col("source_size"))
    for _ in range(MAX_STEPS):
        c, s = cells.alias("c"), state.where(open_source).alias("s")
        x = F.col("c.size") / F.col("s.scale")
        w, mass = _tilt(F.col("s.lam") * x), F.col("c.docs") * F.col("c.size")
        step = c.where("size > 0").join(s, F.col("c.source").eqNullSafe(F.col("s.source"))).groupBy(F.col("s.source").alias("step_source")).agg(
            F.sum(mass * w).alias("taken"), F.sum(F.when(w < CAP, mass * w * x).otherwise(0.0)).alias("slope"),
        )
        moved = state.join(step, F.col("source").eqNullSafe(F.col("step_source")), "left").drop("step_source").withColumns({
            "low": F.when(F.col("taken") < F.col("target"), F.col("lam")).otherwise(F.col("low")),
            "high": F.when(F.col("taken") > F.col("target"), F.col("lam")).otherwise(F.col("high")),
            "off": F.coalesce(F.abs(F.col("taken") / F.col("target") - 1), F.lit(0.0)),
        }).withColumn("newton", F.col("lam") - F.try_divide(F.col("taken") * F.ln(F.col("taken") / F.col("target")), F.col("slope")))
        inside = (F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high"))
        moved = moved.withColumn("lam", F.when((F.col("off") < TOLERANCE) | F.col("taken").isNull(), F.col("lam")).when(inside, F.col("newton")).otherwise(
            F.when(F.col("low") < -9e6, F.col("lam") * 2 - 1).when(F.col("high") > 9e6, F.col("lam") * 2 + 1).otherwise((F.col("low") + F.col("high")) / 2)))
        state = stored(moved.drop("taken", "slope", "newton"), "mix-state")
        if (state.agg(F.max("off")).first()[0] or 0.0) < TOLERANCE:
            break
    else:
        raise RuntimeError(f"the rates of a source did not settle in {MAX_STEPS} steps")
    full = (F.col("target") >= CAP * F.col("source_size")) & (F.col("source_size") > 0)
    return state.select("source", "source_size", "target", "scale", F.when(full, F.lit(None)).otherwise(F.col("lam")).cast("double").alias("lam"))


def _diffused(rows: pd.DataFrame) -> pd.DataFrame:
    """Copies of each cell of one source, from long to short; one row for each distinct size."""
    rows = rows.sort_values("size", ascending=False)
    owed, copies = 0, []
    for size, docs, rate in zip(rows["size"].tolist(), rows["docs"].tolist(), rows["rate"].tolist()):
        if not size:
            copies.append(docs)
            continue
        owed += docs * size * rate
        n = min(int(CAP) * docs, max(0, (owed + size * RATE_UNIT // 2) // (size * RATE_UNIT)))
        owed -= n * size * RATE_UNIT
        copies.append(n)
    return rows.assign(copies=np.array(copies, dtype=np.int64))[["source", "size", "docs", "source_size", "target", "copies"]]


def mix(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, source, ...) with size, source_size, target, copies and taken = size * copies for every row."""
    shield = Shield(docs)
    return _mixed(shield).select(*shield.restored(RESULTS), *RESULTS)


def _mixed(shield: Shield) -> DataFrame:
    """The shielded columns with those of RESULTS."""
    columns = shield.carried()
    slices = max(64, int(shield.frame.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = F.shiftrightunsigned(F.xxhash64(shield["doc_id"], F.coalesce(shield["text"], F.lit(""))), 1)
    rows = shield.frame.select(*columns, shield["source"].alias("source"), word_count(shield["text"]).alias("size"), key.alias("mix_key")).withColumn("slice", F.expr(f"mix_key div {_MASK63 // slices + 1}"))

    sliced = stored(rows.groupBy("source", "size", "slice").agg(F.count("*").alias("docs")), "mix-cells")
    cells = stored(sliced.groupBy("source", "size").agg(F.sum("docs").alias("docs")), "mix-sums")
    solved = solve(cells)
    x = F.col("size") / F.greatest(F.lit(1.0), F.col("scale"))
    rate = F.when(F.col("lam").isNull(), F.lit(CAP)).otherwise(_tilt(F.col("lam") * x))
    rated = cells.join(solved.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).select("source", "size", "docs", "source_size", "target", F.round(rate * RATE_UNIT).cast("long").alias("rate"))
    counted = rated.groupBy("source").applyInPandas(_diffused, "source string, size long, docs long, source_size long, target double, copies long")

    earlier = Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sliced.select("source", "size", "slice", F.coalesce(F.sum("docs").over(earlier), F.lit(0)).alias("rank_before"))
    plan = ranked.alias("r").join(counted.alias("n"), F.col("r.source").eqNullSafe(F.col("n.source")) & (F.col("r.size") == F.col("n.size"))).select(
        F.col("r.source").alias("source"), F.col("r.size").alias("size"), "slice", "rank_before", "source_size", "target",
        F.expr("copies div n.docs").alias("each"), F.expr("copies % n.docs").alias("extra"),
    )
    # plain keys: one exchange of the texts serves the join and the ranking
    key = {"source_key": F.coalesce("source", F.lit("")), "source_null": F.col("source").isNull()}
    cell = ["source_key", "source_null", "size", "slice"]
    joined = rows.withColumns(key).drop("source").join(plan.withColumns(key).drop("source"), cell)
    place = F.row_number().over(Window.partitionBy(*cell).orderBy("mix_key")) + F.col("rank_before")
    out = joined.select(*columns, "size", "source_size", "target", (F.col("each") + F.when(place <= F.col("extra"), 1).otherwise(0)).cast("long").alias("copies"))
    return out.withColumn("taken", F.col("size") * F.col("copies"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of docs."""
    shield = Shield(docs)
    kept = _mixed(shield).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return kept.select(*shield.restored())
