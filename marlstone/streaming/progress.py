"""Progress of jobs as streams (survey T-2 to T-5, S22); records come from sources.robot_log (T-1, T-6)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.media import fraction

OUT = "job string, seq long, current_label string, total_label string, current_fraction double, total_fraction double, message string"
STATE = "current_label string, total_label string"


def fold_labels(key: tuple, frames: Iterator[pd.DataFrame], state: object) -> Iterator[pd.DataFrame]:
    """T-2: carries the labels of PRGC and PRGT records forward and gives a row for each PRGV and MSG record."""
    before = state.get if state.exists else (None, None)
    rows = pd.concat(list(frames)).sort_values("seq", kind="stable").reset_index(drop=True)
    last = []
    for name, mark, old in (("current_label", "PRGC", before[0]), ("total_label", "PRGT", before[1])):
        place = rows.index.to_series().where(rows["kind"] == mark).ffill()  # the record whose label holds here, null or not
        labels = rows["label"].astype(object)
        rows[name] = [old if pd.isna(i) else labels[int(i)] for i in place]
        last.append(rows[name].iloc[-1])
    state.update(tuple(None if pd.isna(x) else x for x in last))
    values, whole = rows["kind"] == "PRGV", rows["max"].fillna(0)
    for name, part in (("current_fraction", "current"), ("total_fraction", "total")):
        rows[name] = (rows[part] / whole.where(whole != 0)).fillna(0.0).where(values)
    rows["message"] = rows["label"].where(rows["kind"] == "MSG")
    rows["job"] = key[0]
    yield rows.loc[values | (rows["kind"] == "MSG"), [c.split()[0] for c in OUT.split(", ")]]


def progress_stream(events: DataFrame) -> DataFrame:
    """events: job, seq, kind, label, current, total, max; a job's records of a batch are taken in order of seq."""
    return events.groupBy("job").applyInPandasWithState(fold_labels, OUT, STATE, "append", "NoTimeout")


def progress_records(records: DataFrame) -> DataFrame:
    """Records (scan_id, seq, kind, fields) as the events that progress_stream takes; others and malformed ones are left out."""
    number = lambda i: F.when(F.get("fields", F.lit(i)).rlike(r"^\+?[0-9]{1,10}$"), F.get("fields", F.lit(i)).cast("bigint"))
    label = F.when(F.col("kind").isin("PRGC", "PRGT"), F.coalesce(F.get("fields", F.lit(2)), F.lit(""))).when(F.col("kind") == "MSG", F.coalesce(F.get("fields", F.lit(3)), F.lit("")))
    need = F.when(F.col("kind").isin("PRGV", "MSG"), 3).when(F.col("kind").isin("PRGC", "PRGT"), 2)
    good = F.size(F.filter(F.array(*(number(i) for i in range(3))), lambda x: x.isNotNull() & (x <= 4294967295)))
    first = F.when(need == 2, number(0).isNotNull() & number(1).isNotNull()).otherwise(good == 3)
    value = lambda i: F.when(F.col("kind") == "PRGV", number(i))
    rows = records.where(need.isNotNull() & first)
    return rows.select(F.col("scan_id").alias("job"), "seq", "kind", label.alias("label"), value(0).alias("current"), value(1).alias("total"), value(2).alias("max"))


def latest_progress(events: DataFrame) -> DataFrame:
    """T-3: only the newest state of each job; what lies between may be dropped."""
    newest = F.max_by(F.struct("current", "total", "max"), "seq")
    return events.where("kind = 'PRGV'").groupBy("job").agg(newest.alias("p")).select("job", fraction(F.col("p.current"), F.col("p.max")).alias("current_fraction"), fraction(F.col("p.total"), F.col("p.max")).alias("total_fraction"))


def job_states(events: DataFrame) -> DataFrame:
    """T-4: the lifecycle of each job's queue, for output mode update.

    events: job, seq, kind (started, event, finished, failed, all_done), item (its place in the queue, from 0), items (the
    queue's length). An item that fails does not end the queue. Gives done and failed (counts), running (the item that
    was started last, unless it has ended since), fraction and shown (place of the item that ended last, as a share and
    as n / m) and state: queued, running, or complete, complete with failures once all_done has come.
    """
    kind = F.col("kind")
    ended = kind.isin("finished", "failed")
    flat = events.groupBy("job").agg(
        F.count_if(kind == "finished").alias("done"), F.count_if(kind == "failed").alias("failed"), F.max("items").alias("_items"), F.bool_or(kind == "all_done").alias("_over"), F.count_if(kind == "started").alias("_begun"),
        F.max_by(F.when(kind == "started", F.col("item")), F.when(kind == "started", F.col("seq"))).alias("_started"), F.max_by(F.when(ended, F.col("item")), F.when(ended, F.col("seq"))).alias("_ended"),
    )
    place = F.col("_ended") + 1
    state = F.when(F.col("_over") & (F.col("failed") == 0), "complete").when(F.col("_over"), "complete with failures").when(F.col("_begun") > 0, "running").otherwise("queued")
    running = F.when(~F.col("_over") & ~F.col("_started").eqNullSafe(F.col("_ended")), F.col("_started"))
    share = F.when(F.col("_over"), F.lit(1.0)).when(F.col("_items") > 0, F.coalesce(place.cast("double") / F.col("_items"), F.lit(0.0))).otherwise(0.0)
    shown = F.when(F.col("_items") > 0, F.concat(place.cast("string"), F.lit(" / "), F.col("_items").cast("string")))
    return flat.select("job", "done", "failed", running.alias("running"), share.alias("fraction"), shown.alias("shown"), state.alias("state"))


def conversion_progress(kind: Column, current_seconds: Column, total_seconds: Column, label: Column, line: Column) -> Column:
    """T-5: struct<current, total, max, label, message> of a conversion's event (kind progress or log).

    Seconds are cut to whole ones, at least 0; max is 0, and the share of what is done then unknown, without a length.
    """
    whole = lambda c: F.greatest(F.lit(0), F.least(F.lit(4294967295), F.floor(F.nanvl(c.cast("double"), F.lit(0.0))))).cast("bigint")
    is_log = kind == "log"
    own = lambda c: F.when(~is_log, c)
    top = F.when(total_seconds > 0, whole(total_seconds)).otherwise(F.lit(0).cast("bigint"))
    return F.struct(own(whole(current_seconds)).alias("current"), own(whole(current_seconds)).alias("total"), own(top).alias("max"), own(label).alias("label"), F.when(is_log, line).alias("message"))


def out_time_seconds(line: Column) -> Column:
    """Seconds of a line out_time_us=<number>; null for others, for N/A and for negative numbers."""
    return F.regexp_extract(line, r"^out_time_us=\s*\+?([0-9]{1,18})\s*$", 1).try_cast("bigint") / F.lit(1e6)


def encoder_progress(lines: DataFrame, duration_us: int) -> DataFrame:
    """S22, T-5: the share of a conversion that is done, from a stream of its lines; others are passed over."""
    return lines.select((out_time_seconds(F.col("value")) * 1e6).alias("_us")).where("_us is not null").select(F.least(F.lit(1.0), F.col("_us") / max(duration_us, 1)).alias("fraction"))
