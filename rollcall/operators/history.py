"""Leak-free per-entity history features.

All features of one call share ONE window spec ``partitionBy(entity)
.orderBy(order...)`` so the physical plan has a single Exchange and a single
Sort for the whole family; the global fill value is a scalar subquery (one
partial/final aggregate, no join).

Skew: an entity holding a large share of all rows would make its window
partition a single task. With ``hot_rows`` set, entities above that many rows go
through a segmented scan instead: a segment is one (entity, calendar day; for times also hour or minute), a
function of the row alone, so a segment never depends on how the rows happen to
be dealt out. Each segment is scanned locally and a summary of one row per
segment supplies the carry-in (counts, sums, trailing run, last three outcomes).
Both routes give identical values and neither starts a job while the plan is
built. The default is the plain route: a student registers for an event once, so
a student has at most as many rows as there are events, and the window spills.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HISTORY_COLUMNS = [
    "student_rolling_attendance",
    "student_cumulative_attended",
    "student_total_events",
    "attendance_streak",
    "student_attendance_std",
    "student_recent_3_rate",
]

def _window(entity: str | Sequence[str], order: Sequence[str]):
    ents = [entity] if isinstance(entity, str) else list(entity)
    return Window.partitionBy(*ents).orderBy(*order)


def overall_rate(df: DataFrame, outcome: str = "attended") -> Column:
    """A16 as a scalar subquery column (evaluated once, no join)."""
    return df.agg(F.avg(F.col(outcome).cast("double"))).scalar()


def _std(n: Column, total: Column) -> Column:
    """Sample standard deviation of ``n`` 0/1 outcomes with sum ``total``, from exact
    integer sums on both routes (the sum of squares is the sum)."""
    n, total = n.cast("double"), total.cast("double")
    return F.when(n > 1, F.sqrt(F.greatest(F.try_divide(total - F.try_divide(total * total, n), n - 1), F.lit(0.0)))).otherwise(F.lit(0.5))


def _runs(df: DataFrame, y: Column, w) -> DataFrame:
    """Add ``_known`` (outcomes so far), ``_first_run`` (still in the first run) and
    ``_run``: the signed length of the run of equal outcomes that ends here. A null
    outcome has run 0 and does not break the run around it."""
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(y, ignorenulls=True).over(before)
    df = df.withColumn("_known", F.count(y).over(upto)).withColumn("_chg", y.isNotNull() & F.coalesce(last != y, F.lit(True)))
    df = df.withColumn("_start", F.max(F.when(F.col("_chg"), F.col("_known"))).over(upto))
    sign = F.when(y == 1, F.lit(1)).otherwise(F.lit(-1))
    run = F.when(y.isNull(), F.lit(0)).otherwise(sign * (F.col("_known") - F.col("_start") + 1))
    return df.withColumn("_run", run.cast("long")).withColumn("_first_run", F.coalesce(F.col("_start") == 1, F.lit(True)))


def _plain(df: DataFrame, entity, order, outcome: str, overall: Column, prior_outcomes: bool = False) -> DataFrame:
    w = _window(entity, order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    last3 = w.rowsBetween(-3, -1)
    y = F.col(outcome)
    tmp = _runs(df, y, w)
    known, total = F.count(y).over(before), F.coalesce(F.sum(y).over(before), F.lit(0))
    return tmp.select(
        *df.columns,
        F.coalesce(F.avg(y).over(before), overall).alias("student_rolling_attendance"),
        total.cast("long").alias("student_cumulative_attended"),
        (F.row_number().over(w) - 1).cast("long").alias("student_total_events"),
        F.coalesce(F.lag("_run").over(w), F.lit(0)).cast("long").alias("attendance_streak"),
        _std(known, total).alias("student_attendance_std"),
        F.coalesce(F.avg(y).over(last3), overall).alias("student_recent_3_rate"),
        *([F.reverse(F.collect_list(y).over(last3)).alias("prior_outcomes")] if prior_outcomes else []),
    )


def _segment_of(df: DataFrame, column: str, span: str) -> Column:
    """Segment of a row by its first order column: the ``span`` (day, hour, minute) that a
    time lies in, else the value itself."""
    return F.date_trunc(span, column) if df.schema[column].dataType.typeName().startswith("timestamp") else F.col(column)


def _segmented(df: DataFrame, entity: str, order: Sequence[str], outcome: str, overall: Column, prior_outcomes: bool = False, span: str = "day") -> DataFrame:
    """History features for hot entities only (see module docstring)."""
    y = F.col(outcome)
    w = Window.partitionBy(entity, "_seg").orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    loc = _runs(df.withColumn("_seg", _segment_of(df, order[0], span)), y, w)
    recent = [F.lag(y, i).over(w) for i in (1, 2, 3)]
    loc = (
        loc.withColumn("_n0", (F.row_number().over(w) - 1).cast("long"))
        .withColumn("_m0", F.count(y).over(before))
        .withColumn("_s0", F.coalesce(F.sum(y).over(before), F.lit(0)).cast("long"))
        .withColumn("_prev_run", F.lag("_run").over(w))
        .withColumn("_prev_first", F.lag("_first_run").over(w))
        .withColumn("_prev3", F.slice(F.array(*recent), F.lit(1), F.least(F.col("_n0"), F.lit(3)).cast("int")))
    )
    # one row per segment; its last three outcomes, latest first
    latest = F.struct(*[F.col(c) for c in order])
    one = F.col("_n0") + 1  # place in the segment
    summary = loc.groupBy(entity, "_seg").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(y).alias("m"),
        F.coalesce(F.sum(y), F.lit(0)).cast("long").alias("s"),
        F.max_by("_run", F.when(y.isNotNull(), one)).alias("trail"),
        F.max_by(y.isNull(), latest).alias("ends_null"),
        F.max_by(F.slice(F.concat(F.array(y), F.col("_prev3")), 1, 3), latest).alias("tail3"),
    )
    sw = Window.partitionBy(entity).orderBy("_seg")
    earlier, upto = sw.rowsBetween(Window.unboundedPreceding, -1), sw.rowsBetween(Window.unboundedPreceding, 0)
    # trailing run of the concatenation: a segment of one run goes on with the run
    # before it if that has the same sign; a segment without outcomes changes nothing
    size, sign = F.coalesce(F.abs("trail"), F.lit(0)), F.signum("trail")
    sign_before = F.last(sign, ignorenulls=True).over(earlier)
    goes_on = (F.col("m") == 0) | F.coalesce((size == F.col("m")) & (sign_before == sign), F.lit(False))
    summary = summary.withColumn("_reset", ~goes_on).withColumn("_cum", F.sum(size).over(upto))
    summary = summary.withColumn("_base", F.max(F.when(F.col("_reset"), F.col("_cum") - size)).over(upto))
    summary = summary.withColumn("_chain", F.when(F.col("m") > 0, sign.cast("long") * (F.col("_cum") - F.coalesce("_base", F.lit(0)))))
    tails = F.flatten(F.reverse(F.collect_list("tail3").over(sw.rowsBetween(-3, -1))))  # latest segment first
    carry = summary.select(
        entity,
        "_seg",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("c_n"),
        F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("c_m"),
        F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("c_s"),
        F.coalesce(F.last("_chain", ignorenulls=True).over(earlier), F.lit(0)).cast("long").alias("c_run"),
        F.coalesce(F.lag("ends_null").over(sw), F.lit(False)).alias("c_null"),
        F.slice(tails, 1, 3).alias("c_last3"),
    )
    lost = F.raise_error(F.lit("a history row has no segment"))
    j = loc.join(carry, [entity, "_seg"], "left").withColumn("c_n", F.when(F.col("c_n").isNull(), lost.cast("long")).otherwise(F.col("c_n")))
    n, m, s = F.col("_n0") + F.col("c_n"), F.col("_m0") + F.col("c_m"), F.col("_s0") + F.col("c_s")
    # streak before this row: the previous row's run inside the segment (with the carry
    # while still in the first run), or the carry itself on the segment's first row
    run = F.col("_prev_run")
    joined = F.when(F.col("_prev_first") & (F.signum("c_run") == F.signum(run)), run + F.col("c_run")).otherwise(run)
    streak = F.when(F.col("_n0") > 0, joined).when(F.col("c_null"), F.lit(0)).otherwise(F.col("c_run"))
    # the last three rows; null outcomes take a place but no part
    merged = F.filter(F.slice(F.concat("_prev3", "c_last3"), 1, 3), lambda v: v.isNotNull())
    recent3 = F.try_divide(F.aggregate(merged, F.lit(0.0), lambda acc, v: acc + v), F.size(merged))
    return j.select(
        *df.columns,
        F.coalesce(F.try_divide(s.cast("double"), m), overall).alias("student_rolling_attendance"),
        s.cast("long").alias("student_cumulative_attended"),
        n.cast("long").alias("student_total_events"),
        streak.cast("long").alias("attendance_streak"),
        _std(m, s).alias("student_attendance_std"),
        F.coalesce(recent3, overall).alias("student_recent_3_rate"),
        *([merged.alias("prior_outcomes")] if prior_outcomes else []),
    )


def history_features(
    df: DataFrame,
    entity: str = "student_id",
    order: Sequence[str] = ("event_date", "event_id"),
    outcome: str = "attended",
    overall: Column | None = None,
    hot_rows: int | None = None,
    prior_outcomes: bool = False,
    span: str = "day",
) -> DataFrame:
    """W1-W6 on ``df``. A null outcome counts as an event, takes part in no rate, and
    leaves a streak of 0 behind without ending the run. ``hot_rows`` sends entities
    with more rows through the segmented route. ``prior_outcomes`` adds the up-to-three
    previous outcomes, most recent first. ``span`` is the length of a segment where the
    first order column is a time: take hours or minutes where an entity's day is too much
    for a task; an entity's summaries are then as many as the spans it has rows in."""
    if span not in ("day", "hour", "minute"):
        raise ValueError("span is 'day', 'hour' or 'minute'")
    order = list(order)
    overall = overall if overall is not None else overall_rate(df, outcome)
    if hot_rows is None:
        return _plain(df, entity, order, outcome, overall, prior_outcomes)
    # rows without an entity take the plain route, as no key equals theirs; the others have
    # the same filter in both parts, so that they are shuffled once for both
    nobody = _plain(df.filter(F.col(entity).isNull()), entity, order, outcome, overall, prior_outcomes)
    known = df.filter(F.col(entity).isNotNull())
    if hot_rows <= 0:
        # every entity has more rows than that: nothing to look up, rows are dealt by segment only
        return nobody.unionByName(_segmented(known, entity, order, outcome, overall, prior_outcomes, span))
    # at most rows / hot_rows keys; Spark broadcasts them if they are few
    hot = known.groupBy(entity).agg(F.count(F.lit(1)).alias("_cnt")).filter(F.col("_cnt") > hot_rows).select(entity)
    cold_part, hot_part = known.join(hot, entity, "left_anti").select(*df.columns), known.join(hot, entity, "left_semi").select(*df.columns)
    return _plain(cold_part, entity, order, outcome, overall, prior_outcomes).unionByName(nobody).unionByName(
        _segmented(hot_part, entity, order, outcome, overall, prior_outcomes, span)
    )


def recalculate_history(
    df: DataFrame,
    entity: str = "student_id",
    order: Sequence[str] = ("event_date", "event_id"),
    outcome: str = "attended",
    hot_rows: int | None = None,
) -> DataFrame:
    """``past_attendance_rate`` (3-decimal half-even, first 0.0) and ``past_events_count``.
    Same window family as W1/W3 (hot entities take the segmented route)."""
    keep = [c for c in df.columns if c not in ("past_attendance_rate", "past_events_count")]
    h = history_features(df.select(*keep), entity, order, outcome, overall=F.lit(0.0), hot_rows=hot_rows)
    return h.select(
        *keep,
        F.bround(F.col("student_rolling_attendance"), 3).alias("past_attendance_rate"),
        F.col("student_total_events").alias("past_events_count"),
    )


def momentum_score(
    df: DataFrame,
    base: Column,
    entity: str = "student_id",
    order: Sequence[str] = ("event_date", "event_id"),
    outcome: str = "attended",
    hot_rows: int | None = None,
) -> DataFrame:
    """``df`` plus ``momentum`` = base + (mean of up to three prior outcomes - 0.3) * 0.25,
    clamped to [0.03, 0.90]; rows without history keep the base."""
    h = history_features(df.withColumn("_base", base), entity, order, outcome, overall=F.lit(0.0), hot_rows=hot_rows)
    recent = F.col("student_recent_3_rate")
    adjusted = F.when(F.col("student_total_events") == 0, F.col("_base")).otherwise(
        F.col("_base") + (recent - F.lit(0.3)) * F.lit(0.25)
    )
    m = F.least(F.lit(0.90), F.greatest(F.lit(0.03), adjusted))
    return h.select(*df.columns, m.alias("momentum"))
