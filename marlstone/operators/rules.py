"""Diagnostic events of runs by fixed rules on their metric series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import short_hash
from .metrics import window_size, with_streaks


def features(df: DataFrame) -> DataFrame:
    """One row per run that has a loss. ``df``: raw rows ``run, line, step, loss,
    clip, skip, head, other, lr, resumed``, and ``other2`` where there is a second
    head beside the primary one; where a step repeats the last row counts."""
    if "other2" not in df.columns:
        df = df.withColumn("other2", F.lit(None).cast("double"))
    by = Window.partitionBy("run")
    last = F.row_number().over(Window.partitionBy("run", "step").orderBy(F.desc("line")))
    again = df.where("step is not null").groupBy("run").agg(
        (F.count("step") - F.count_distinct("step")).alias("duplicates"), F.max(F.coalesce("resumed", F.lit(False))).alias("resumed")
    )
    rows = df.where("step is not null").withColumn("k__", last).where("k__ = 1").drop("k__")
    rows = with_streaks(rows, F.coalesce(F.col("skip") > 0, F.lit(False)), "skip_streak")
    has = F.col("loss").isNotNull()
    part = Window.partitionBy("run", has)
    rows = rows.withColumn("n__", F.count("loss").over(by)).withColumn("a__", F.when(has, F.row_number().over(part.orderBy("step"))))
    size = window_size(F.col("n__"))
    tail = has & (F.col("a__") > F.col("n__") - size)
    ends = lambda c, f: f(c, F.when(F.col(c).isNotNull(), F.col("step")))
    best = F.min(F.when(has, F.struct("loss", "step")))
    return (
        rows.groupBy("run")
        .agg(
            F.count("loss").alias("n"),
            F.min(F.when(has, F.col("step"))).alias("start_step"),
            F.max(F.when(has, F.col("step"))).alias("end_step"),
            best["loss"].alias("best"),
            best["step"].alias("best_step"),
            ends("loss", F.min_by).alias("first"),
            ends("loss", F.max_by).alias("final"),
            F.avg(F.when(has & (F.col("a__") <= size), F.col("loss"))).alias("early"),
            F.avg(F.when(tail, F.col("loss"))).alias("tail"),
            F.min(F.when(tail, F.col("loss"))).alias("tail_min"),
            F.max(F.when(tail, F.col("loss"))).alias("tail_max"),
            F.max("clip").alias("clip_max"),
            F.max("skip").alias("skip_max"),
            F.max("skip_streak").alias("skip_streak"),
            F.count("head").alias("heads"),
            ends("head", F.min_by).alias("head_first"),
            ends("head", F.max_by).alias("head_last"),
            ends("other", F.min_by).alias("other_first"),
            ends("other", F.max_by).alias("other_last"),
            ends("other2", F.min_by).alias("other2_first"),
            ends("other2", F.max_by).alias("other2_last"),
            ends("lr", F.max_by).alias("lr_last"),
            F.min("lr").alias("lr_min"),
        )
        .where("n > 0")
        .join(again, "run")
    )


def events(feats: DataFrame) -> DataFrame:
    """``id, run, event, severity, start_step, end_step``."""
    c = F.col
    flat = (c("tail_max") - c("tail_min")) / F.greatest(F.abs("tail"), F.lit(1e-12))
    # either of the other heads stays flat
    flat_head = F.coalesce(c("other_last") >= 0.95 * c("other_first"), F.lit(False)) | F.coalesce(c("other2_last") >= 0.95 * c("other2_first"), F.lit(False))
    rules = [
        ("converged", "info", (c("early") > 0) & (c("tail") < 0.30 * c("early")) & (flat <= 0.50)),
        ("bad_plateau", "warning", (c("n") >= 3) & (c("best_step") < c("end_step")) & (c("tail") > 2 * c("best")) & (c("final") > 2 * c("best"))),
        ("clip_storm", "warning", (c("clip_max") > 0.50) & (c("final") > c("first"))),
        ("skip_loop", "warning", (c("skip_max") > 0.30) | (c("skip_streak") > 50)),
        ("primary_head_failure", "warning", (c("heads") >= 2) & (c("head_last") <= 0.5 * c("head_first")) & flat_head),
        ("lr_floor_freeze", "warning", (c("lr_last") <= c("lr_min") * (1 + 1e-9)) & (c("final") >= 1.02 * c("best"))),
        ("resume_boundary", "info", (c("duplicates") > 0) | c("resumed")),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(p, F.lit(False)), F.struct(F.lit(e).alias("event"), F.lit(s).alias("severity"))) for e, s, p in rules]))
    out = feats.select("run", "start_step", "end_step", F.explode(found).alias("e")).select("run", "e.event", "e.severity", "start_step", "end_step")
    run, event, a, b = (c(x).cast("string") for x in ("run", "event", "start_step", "end_step"))
    return out.select(short_hash(run, event, a, b, sep=":").alias("id"), "*")
