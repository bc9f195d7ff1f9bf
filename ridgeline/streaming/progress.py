"""Progress of jobs: log lines to states, as batch windows and as streams.

A line log is (job_id, seq, line). `stage: name (note) ...` starts a stage,
`stage: name: X s` ends it, `progress: iter=...` or `progress: workers=...` reports
a search, and `total_objective: X` its result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

#: The lines that move a state (fixed formats).
START = r"^stage: (.+?) \.\.\.$"
DONE = r"^stage: (.+): ([0-9]+(?:\.[0-9]+)?) s$"
SOLVE = r"^progress: iter=([0-9]+) best_objective=(-?[0-9]+(?:\.[0-9]+)?) elapsed=([0-9]+(?:\.[0-9]+)?)s"
WORKERS = r"^progress: workers=[0-9]+/[0-9]+ iters=([0-9]+) best_worker_objective=(-?[0-9]+(?:\.[0-9]+)?) elapsed=([0-9]+(?:\.[0-9]+)?)s"
SUMMARY = r"^total_objective: (-?[0-9]+(?:\.[0-9]+)?)$"

#: Stages of a job of each kind, in order (fixed values).
STAGES = {
    "setup": ("osm-load", "trail-filter", "polyline-smoothing", "resampling", "dem-resolve", "elevation-sampling", "cache-write"),
    "query": ("load-prepared-area", "elevation-reshape", "trail-filter", "climb-detection", "climb-contraction", "validate-render"),
}
TAIL = 20

LOG = "job_id string, seq long, line string"
STATE = "job_id string, seq long, phase string, stage_index int, stage_total int, stage_name string, iter long, best double, elapsed double, log_tail array<string>"


def parse_lines(lines: DataFrame) -> DataFrame:
    """Adds kind (start, done, solve, summary, other), stage_name, iter, best and elapsed; blank lines go. A note in brackets isn't part of a stage's name."""
    line = F.col("line")
    kinds = (("start", START), ("done", DONE), ("solve", SOLVE), ("solve", WORKERS), ("summary", SUMMARY))
    kind = F.lit("other")
    for name, pattern in reversed(kinds):
        kind = F.when(line.rlike(pattern), name).otherwise(kind)
    text = lambda pattern, k: F.nullif(F.regexp_extract(line, pattern, k), F.lit(""))
    either = lambda k: F.coalesce(text(SOLVE, k), text(WORKERS, k))
    return lines.where(F.trim(line) != "").withColumns(
        {
            "kind": kind,
            "stage_name": F.coalesce(F.substring_index(text(START, 1), " (", 1), text(DONE, 1)),
            "iter": either(1).cast("long"),
            "best": F.coalesce(either(2), text(SUMMARY, 1)).cast("double"),
            "elapsed": F.coalesce(text(DONE, 2), either(3)).cast("double"),
        }
    )


def states(lines: DataFrame, kind: str = "query") -> DataFrame:
    """The state after each line. Only a start moves the stage, and it ends a search; a setup job has none; the last lines ride along."""
    job = Window.partitionBy("job_id").orderBy("seq")
    w = job.rowsBetween(Window.unboundedPreceding, 0)
    rows = parse_lines(lines).withColumn("_solves", (F.col("kind") == "solve") & F.lit(kind == "query"))
    rows = rows.withColumn("stage_index", F.sum((F.col("kind") == "start").cast("int")).over(w).cast("int"))
    timed = (F.col("kind") == "done") | F.col("_solves")
    rows = rows.withColumns(
        {
            "_name": F.last("stage_name", ignorenulls=True).over(w),
            "_elapsed": F.last(F.when(timed, F.col("elapsed")), ignorenulls=True).over(w),
            "log_tail": F.collect_list("line").over(job.rowsBetween(1 - TAIL, 0)),
        }
    )
    stage = Window.partitionBy("job_id", "stage_index").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(F.when(F.col("_solves"), F.col(c)), ignorenulls=True).over(stage)
    phase = F.when(F.bool_or("_solves").over(stage), "solve").otherwise(kind)
    return rows.select(
        "job_id", "seq", phase.alias("phase"), "stage_index", F.lit(len(STAGES[kind])).alias("stage_total"), F.col("_name").alias("stage_name"),
        last("iter").alias("iter"), last("best").alias("best"), F.col("_elapsed").alias("elapsed"), "log_tail",
    )


def summary_objective(lines: DataFrame) -> DataFrame:
    """(job_id, objective): what a finished search reports last."""
    rows = parse_lines(lines).where("kind = 'summary'")
    return rows.groupBy("job_id").agg(F.max_by("best", "seq").alias("objective"))


def stream_states(lines: DataFrame, kind: str = "query") -> DataFrame:
    """The same for a stream: state is kept for each job, and rows come out as lines come in (append mode)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stage, name, phase, done, best, elapsed, tail = state.get if state.exists else (0, None, kind, None, None, None, "")
        held = tail.split("\n") if tail else []
        for batch in batches:
            out = []
            for r in batch.sort_values("seq").itertuples():
                held = [*held, r.line][-TAIL:]
                if r.kind == "start":
                    stage, name, phase, done, best = stage + 1, r.stage_name, kind, None, None
                elif r.kind == "solve" and kind == "query":
                    phase, done, best, elapsed = "solve", int(r.iter), float(r.best), float(r.elapsed)
                elif r.kind == "done":
                    name, elapsed = r.stage_name, float(r.elapsed)
                out.append((key[0], int(r.seq), phase, stage, len(STAGES[kind]), name, done, best, elapsed, list(held)))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in STATE.split(", ")])
            yield frame.astype({"iter": "Int64", "best": "Float64", "elapsed": "Float64"})
        state.update((stage, name, phase, done, best, elapsed, "\n".join(held)))

    kept = "stage int, name string, phase string, iter long, best double, elapsed double, tail string"
    return parse_lines(lines).groupBy("job_id").applyInPandasWithState(step, STATE, kept, "append", GroupStateTimeout.NoTimeout)


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of JSON lines; lines that aren't valid are dropped, and (job_id, seq) is taken once."""
    rows = spark.readStream.schema(LOG).option("mode", "DROPMALFORMED").json(folder)
    return rows.where("job_id is not null and seq is not null").dropDuplicates(["job_id", "seq"])


def snapshot_then_tail(snapshot: DataFrame, tail: DataFrame) -> DataFrame:
    """A stored snapshot and a live tail as one log without gaps or repeats."""
    reached = snapshot.groupBy("job_id").agg(F.max("seq").alias("_reached"))
    fresh = tail.join(reached, "job_id", "left").where(F.col("_reached").isNull() | (F.col("seq") > F.col("_reached"))).drop("_reached")
    return snapshot.unionByName(fresh.dropDuplicates(["job_id", "seq"]))


def stage_timing(starts: DataFrame) -> DataFrame:
    """(job_id, ts, stage, seconds until the next stage) of (job_id, ts, stage)."""
    after = F.lead("ts").over(Window.partitionBy("job_id").orderBy("ts", "stage"))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return starts.withColumn("seconds", (micros(after) - micros(F.col("ts"))) / F.lit(1e6))


def stagnation(progress: DataFrame) -> DataFrame:
    """Adds still: iterations since the last admission, of (worker, iter, admitted)."""
    w = Window.partitionBy("worker").orderBy("iter").rowsBetween(Window.unboundedPreceding, 0)
    return progress.withColumn("still", F.col("iter") - F.coalesce(F.max(F.when(F.col("admitted"), F.col("iter"))).over(w), F.lit(0)))


def worker_progress(progress: DataFrame) -> DataFrame:
    """(iterations, best, workers): the latest of each worker, added up."""
    latest = progress.groupBy("worker").agg(F.max_by("iter", "ts").alias("iter"), F.max("best").alias("best"))
    return latest.agg(F.sum("iter").alias("iterations"), F.max("best").alias("best"), F.count("*").alias("workers"))


def merged_status(workers: DataFrame) -> DataFrame:
    return workers.agg(F.when(F.every(F.col("status") == "converged"), "converged").otherwise("budget-exhausted").alias("status"), F.max("iter").alias("iter"))


def remaining_seconds(iteration: Column, budget: Column, elapsed: Column) -> Column:
    """Null where nothing can be measured yet."""
    known = (iteration > 0) & (elapsed > 0) & (budget > 0)
    return F.when(known, F.greatest(F.lit(0.0), (budget - iteration) * elapsed / iteration))


def throttled(events: DataFrame, interval: float) -> DataFrame:
    """Events (key, t) that fire: the first, then each at least `interval` after the last that fired."""
    times = events.groupBy("key").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    start = F.struct(F.lit(float("-inf")).alias("next"), F.array().cast("array<double>").alias("fired"))
    step = lambda acc, t: F.when(t >= acc["next"], F.struct((t + interval).alias("next"), F.array_append(acc["fired"], t).alias("fired"))).otherwise(acc)
    return times.select("key", F.explode(F.aggregate("ts", start, step)["fired"]).alias("t"))
