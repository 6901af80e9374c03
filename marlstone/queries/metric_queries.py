"""Queries over metric logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import controller, metrics, rules
from .registry import register
from .standins import DEDUPED, METRICS, deduped, rounded
from .standins import metrics as log


@register(
    "run_metric_summary",
    f"""WITH {DEDUPED}, r AS (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY step) AS a, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS z FROM d)
SELECT run, count(*) AS row_count, round(min(loss), 6) AS best_loss,
       min(CASE WHEN loss = lo THEN step END) AS best_step, round(arg_max(loss, step), 6) AS final_loss,
       round(avg(CASE WHEN a <= 10 THEN loss END), 6) AS early_loss, round(avg(CASE WHEN z <= 10 THEN loss END), 6) AS tail_loss,
       round(quantile_cont(norm, 0.5), 6) AS norm_p50, round(quantile_cont(norm, 0.95), 6) AS norm_p95,
       round(quantile_cont(norm, 0.99), 6) AS norm_p99, round(max(norm), 6) AS norm_max,
       count(CASE WHEN clipped THEN 1 END) AS clip_count, count(CASE WHEN skipped THEN 1 END) AS skip_count,
       round(avg(CAST(clipped AS INT)), 6) AS clip_mean, round(avg(CAST(skipped AS INT)), 6) AS skip_mean
FROM (SELECT *, min(loss) OVER (PARTITION BY run) AS lo FROM r) GROUP BY run""",
)
def run_metric_summary(spark, sf_dir):
    d = deduped(spark, sf_dir).withColumn("clipped", F.col("clipped").cast("int")).withColumn("skipped", F.col("skipped").cast("int"))
    return rounded(metrics.summarise(d))


@register("metric_dedupe_last_wins", f"WITH {DEDUPED} SELECT run, step, line, loss FROM d")
def metric_dedupe_last_wins(spark, sf_dir):
    return deduped(spark, sf_dir).select("run", "step", "line", "loss")


@register("metric_last_known", f"WITH {METRICS} SELECT run, step, arg_max(loss, line) AS loss, arg_max(CASE WHEN skipped THEN norm END, line) AS skip_norm FROM (SELECT * FROM m) GROUP BY run, step".replace(
    "arg_max(CASE WHEN skipped THEN norm END, line)", "arg_max(norm, CASE WHEN skipped THEN line END)"))
def metric_last_known(spark, sf_dir):
    m = log(spark, sf_dir).withColumn("skip_norm", F.when(F.col("skipped"), F.col("norm")))
    return metrics.last_known(m, ["run", "step"], "line", ["loss", "skip_norm"])


@register(
    "metric_row_predicate",
    f"WITH {METRICS} SELECT run, line, step FROM m WHERE rank IN (0, 2) AND step BETWEEN 10 AND 60 AND loss IS NOT NULL",
)
def metric_row_predicate(spark, sf_dir):
    keep = F.col("rank").isin(0, 2) & F.col("step").between(10, 60) & F.col("loss").isNotNull()
    return log(spark, sf_dir).where(keep).select("run", "line", "step")


@register(
    "metric_downsample_stride",
    f"""WITH {DEDUPED}, r AS (SELECT run, step, loss, count(*) OVER (PARTITION BY run) AS n, row_number() OVER (PARTITION BY run ORDER BY step) - 1 AS i FROM d)
SELECT run, step, loss, CASE WHEN n <= 20 THEN 'raw' ELSE 'stride' END AS aggregation FROM r
WHERE n <= 20 OR i % CAST(ceil(n / 20.0) AS BIGINT) = 0 OR i = n - 1""",
)
def metric_downsample_stride(spark, sf_dir):
    return metrics.downsample(deduped(spark, sf_dir).select("run", "step", "loss"), 20)


@register(
    "rolling_flag_rate",
    f"WITH {DEDUPED} SELECT run, step, round(avg(CAST(clipped AS INT)) OVER (PARTITION BY run ORDER BY step ROWS 19 PRECEDING), 6) AS rate FROM d",
)
def rolling_flag_rate(spark, sf_dir):
    return rounded(deduped(spark, sf_dir).select("run", "step", metrics.rolling_rate(F.col("clipped"), 20).alias("rate")))


@register(
    "streak_lengths",
    f"""WITH {DEDUPED}, g AS (SELECT run, step, CAST(skipped AS INT) AS f, sum(1 - CAST(skipped AS INT)) OVER (PARTITION BY run ORDER BY step) AS isl FROM d)
SELECT run, step, CAST(sum(f) OVER (PARTITION BY run, isl ORDER BY step) AS BIGINT) AS streak FROM g""",
)
def streak_lengths(spark, sf_dir):
    return metrics.with_streaks(deduped(spark, sf_dir), F.col("skipped")).select("run", "step", "streak")


@register(
    "cumulative_flags",
    f"""WITH {DEDUPED} SELECT run, step, CAST(sum(CAST(clipped AS INT)) OVER w AS BIGINT) AS clips, CAST(sum(CAST(skipped AS INT)) OVER w AS BIGINT) AS skips
FROM d WINDOW w AS (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING)""",
)
def cumulative_flags(spark, sf_dir):
    return deduped(spark, sf_dir).select("run", "step", metrics.running(F.col("clipped")).alias("clips"), metrics.running(F.col("skipped")).alias("skips"))


@register(
    "forward_fill",
    f"""WITH {DEDUPED} SELECT run, step, coalesce(last_value(CASE WHEN clipped THEN norm END IGNORE NULLS) OVER
  (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING), 0) AS norm FROM d""",
)
def forward_fill(spark, sf_dir):
    value = F.when(F.col("clipped"), F.col("norm"))
    return deduped(spark, sf_dir).select("run", "step", metrics.filled(value, F.lit(0.0)).alias("norm"))


@register(
    "centered_moving_average",
    f"""WITH {DEDUPED}, r AS (SELECT run, step, loss, row_number() OVER (PARTITION BY run ORDER BY step) - 1 AS i, count(*) OVER (PARTITION BY run) AS n,
  first_value(loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f,
  last_value(loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l,
  sum(loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM d)
SELECT run, step, round(CASE WHEN n < 5 THEN loss ELSE (s + greatest(0, 2 - i) * f + greatest(0, i + 2 - (n - 1)) * l) / 5 END, 6) AS smooth FROM r""",
)
def centered_moving_average(spark, sf_dir):
    return rounded(metrics.smoothed(deduped(spark, sf_dir), "loss", 5).select("run", "step", "smooth"))


_WINDOWS = [("early", 0, 20), ("middle", 15, 90), ("late", 90, 180), ("none", 5000, 6000)]


@register(
    "interval_window_means",
    f"""WITH {DEDUPED}, w AS (SELECT * FROM (VALUES {', '.join(map(str, _WINDOWS))}) AS t("window", lo, hi))
SELECT w."window" AS "window", CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi, count(step) AS n_rows, round(avg(loss), 6) AS mean_loss, round(avg(norm), 6) AS mean_norm,
       round(avg(lr), 6) AS mean_lr, round(count(CASE WHEN clipped THEN 1 END) / nullif(count(norm), 0), 6) AS clip_rate,
       round(avg(CASE WHEN clipped AND norm > 0 THEN 5.0 / norm END), 6) AS mean_clip_ratio
FROM w LEFT JOIN d ON step > lo AND step <= hi GROUP BY w."window", lo, hi""",
)
def interval_window_means(spark, sf_dir):
    windows = spark.createDataFrame(_WINDOWS, "window string, lo bigint, hi bigint")
    return rounded(metrics.interval_means(deduped(spark, sf_dir).withColumn("threshold", F.lit(5.0)), windows))


_ACTIONS = ["pass", "clip", "skip_norm", "skip_nan", "no_step"]


@register(
    "action_distribution",
    f"""WITH {METRICS}, a AS (SELECT unnest({_ACTIONS}) AS action)
SELECT a.action AS action, count(m.line) AS n, round(100.0 * count(m.line) / (SELECT count(*) FROM m), 6) AS percent FROM a LEFT JOIN m ON m.action = a.action GROUP BY a.action""",
)
def action_distribution(spark, sf_dir):
    return rounded(metrics.category_shares(log(spark, sf_dir), "action", _ACTIONS))


_SIZE = "least(100, greatest(3, CASE WHEN n // 10 = 0 THEN 1 ELSE n // 10 END))"


@register(
    "first_last_window_drop",
    f"""WITH {DEDUPED}, r AS (SELECT run, loss, count(*) OVER (PARTITION BY run) AS n, row_number() OVER (PARTITION BY run ORDER BY step) AS a FROM d),
o AS (SELECT run, max(n) AS n, avg(CASE WHEN a <= {_SIZE} THEN loss END) AS fm, avg(CASE WHEN a > n - {_SIZE} THEN loss END) AS lm FROM r GROUP BY run)
SELECT run, n, round(fm, 6) AS first_mean, round(lm, 6) AS last_mean, round((fm - lm) / greatest(abs(fm), 1e-12), 6) AS "drop" FROM o""",
)
def first_last_window_drop(spark, sf_dir):
    return rounded(metrics.window_drop(deduped(spark, sf_dir), "loss"))


@register(
    "stream_extremes",
    f"""WITH {METRICS} SELECT run, max(norm) AS norm_max, min(norm) AS norm_min, max(CASE WHEN clipped THEN norm END) AS clipped_max,
  arg_min(norm, CASE WHEN skipped THEN line END) AS first_skipped FROM m GROUP BY run""",
)
def stream_extremes(spark, sf_dir):
    return log(spark, sf_dir).groupBy("run").agg(
        F.max("norm").alias("norm_max"), F.min("norm").alias("norm_min"), F.max(F.when(F.col("clipped"), F.col("norm"))).alias("clipped_max"),
        F.min_by("norm", F.when(F.col("skipped"), F.col("line"))).alias("first_skipped"),
    )


@register(
    "health_verdict",
    f"""WITH {DEDUPED}, g AS (SELECT *, sum(1 - CAST(skipped AS INT)) OVER (PARTITION BY run ORDER BY step) AS isl FROM d),
s AS (SELECT *, sum(CAST(skipped AS INT)) OVER (PARTITION BY run, isl ORDER BY step) AS streak FROM g),
o AS (SELECT run, avg(CAST(skipped AS INT)) AS share, max(streak) AS longest, max(norm) AS top, arg_min(loss, step) AS f, arg_max(loss, step) AS l FROM s GROUP BY run)
SELECT run, round(share, 6) AS skip_share, CAST(longest AS BIGINT) AS longest_streak, round(top, 6) AS norm_max, round(f, 6) AS first_loss, round(l, 6) AS last_loss,
  share > 0.3 AS too_many_skips, longest >= 3 AS long_streak, top >= 25 AS huge_norm, l > 1.5 * f AS worse_loss,
  share > 0.3 OR longest >= 3 OR top >= 25 OR l > 1.5 * f AS unhealthy FROM o""",
)
def health_verdict(spark, sf_dir):
    return rounded(metrics.health(deduped(spark, sf_dir), 0.3, 3, 25.0))


_P = controller.Settings(static_clip=10.0, beta=0.9, clip_ratio=1.5, skip_ratio=3.0, skip_max=30.0, clip_min=0.5, clip_max=20.0, warm=5, most_skips=3, runaway=1.2, hard_limit=45.0)
_READY = f"(z.observed >= {_P.warm} AND z.observed > 0)"
_CLIP = f"CASE WHEN {_READY} THEN greatest({_P.clip_min}, least({_P.clip_max}, z.ema * {_P.clip_ratio})) ELSE {_P.static_clip} END"
_SKIP = f"CASE WHEN {_READY} THEN least(z.ema * {_P.skip_ratio}, {_P.skip_max}, {_P.hard_limit}) ELSE {_P.hard_limit} END"
_IS_SKIP = f"w.norm > {_SKIP}"
_IS_CLIP = f"(NOT {_IS_SKIP} AND w.norm > {_CLIP})"
_GIVEN = f"least(CASE WHEN z.observed = 0 THEN w.norm ELSE least(w.norm, z.ema * {_P.clip_ratio}) END, {_P.cap})"
_MEAN = f"CASE WHEN {_IS_SKIP} THEN z.ema WHEN z.observed = 0 THEN {_GIVEN} ELSE {_P.beta} * z.ema + {1.0 - _P.beta} * {_GIVEN} END"
_IN_ROW = f"CASE WHEN {_IS_SKIP} THEN z.skips_in_row + 1 ELSE 0 END"
_CLIP_ROW = f"CASE WHEN {_IS_CLIP} THEN z.clips_in_row + 1 ELSE 0 END"
_REASON = f"CASE WHEN w.norm > {_P.hard_limit} THEN 'hard_limit' WHEN {_IN_ROW} >= {_P.most_skips} THEN 'skips_in_row' WHEN {_MEAN} > {_P.cap * _P.runaway} THEN 'runaway' END"


def _pack(*values, norm="CAST(NULL AS DOUBLE)", at="CAST(NULL AS BIGINT)"):
    kinds = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR"}
    fields = ", ".join(f"{name} := CAST({v} AS {kinds[kind]})" for v, (name, kind) in zip(values, controller.STATE))
    return f"struct_pack(norm := {norm}, step := {at}, {fields})"


_ZERO = (0, "0.0", "0.0", 0, 0, 0, 0, 0, 0, 0, "NULL", "NULL")
_NEXT = _pack(
    f"z.observed + CASE WHEN {_IS_SKIP} THEN 0 ELSE 1 END", _MEAN, f"greatest(z.ema_max, CASE WHEN {_IS_SKIP} THEN z.ema_max ELSE {_MEAN} END)",
    f"z.passed + CASE WHEN {_IS_SKIP} OR {_IS_CLIP} THEN 0 ELSE 1 END", f"z.clipped + CASE WHEN {_IS_CLIP} THEN 1 ELSE 0 END", f"z.skipped + CASE WHEN {_IS_SKIP} THEN 1 ELSE 0 END",
    _IN_ROW, _CLIP_ROW, f"greatest(z.longest_skips, {_IN_ROW})", f"greatest(z.longest_clips, {_CLIP_ROW})", f"CASE WHEN ({_REASON}) IS NOT NULL THEN w.step END", _REASON,
)
_NAMES = ", ".join(f"round(s.{n}, 6) AS {n}" if k == "double" else f"s.{n} AS {n}" for n, k in controller.STATE)


@register(
    "clip_controller_replay",
    f"""WITH {DEDUPED}, l AS (SELECT run, list({_pack(*_ZERO, norm='norm', at='step')} ORDER BY step, norm) AS rows FROM d WHERE norm IS NOT NULL GROUP BY run),
f AS (SELECT run, list_reduce(rows, lambda z, w: CASE WHEN z.reason IS NOT NULL THEN z ELSE {_NEXT} END, {_pack(*_ZERO)}) AS s FROM l)
SELECT run, {_NAMES} FROM f""",
)
def clip_controller_replay(spark, sf_dir):
    return rounded(controller.replay(deduped(spark, sf_dir), _P))


@register(
    "cross_rank_reduce",
    f"""WITH {METRICS} SELECT step, count(*) AS ranks, round(avg(loss), 6) AS loss_mean, min(loss) AS loss_min, max(loss) AS loss_max, round(avg(norm * 100), 6) AS step_ms_mean,
  round(max(norm * 100), 6) AS step_ms_max, round(max(norm / 7), 6) AS load_s_max, round(sum(loss * 2), 6) AS samples_per_s, round(sum(loss * 128), 6) AS tokens_per_s FROM m GROUP BY step""",
)
def cross_rank_reduce(spark, sf_dir):
    m = log(spark, sf_dir).select("step", "loss", (F.col("norm") * 100).alias("step_ms"), (F.col("norm") / 7).alias("load_s"),
                                  (F.col("loss") * 2).alias("samples_per_s"), (F.col("loss") * 128).alias("tokens_per_s"))
    return rounded(metrics.reduced_over_ranks(m))


_FEATURES = """, v AS (SELECT *, count(*) OVER (PARTITION BY run) AS n, row_number() OVER (PARTITION BY run ORDER BY step) AS a,
  sum(CASE WHEN skip > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY run ORDER BY step) AS isl FROM q),
s AS (SELECT *, sum(CASE WHEN skip > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY run, isl ORDER BY step) AS streak FROM v),
g AS (SELECT run, max(n) AS n, min(step) AS start_step, max(step) AS end_step, min(loss) AS best, arg_min(loss, step) AS first, arg_max(loss, step) AS final,
  avg(CASE WHEN a <= SIZE THEN loss END) AS early, avg(CASE WHEN a > n - SIZE THEN loss END) AS tail, min(CASE WHEN a > n - SIZE THEN loss END) AS tmin,
  max(CASE WHEN a > n - SIZE THEN loss END) AS tmax, max(clip) AS clip_max, max(skip) AS skip_max, max(streak) AS streak, arg_min(head, step) AS hf,
  arg_max(head, step) AS hl, arg_min(other, step) AS o1, arg_max(other, step) AS o2, arg_max(lr, step) AS lr_last, min(lr) AS lr_min FROM s GROUP BY run),
b AS (SELECT s.run AS run, min(step) AS best_step FROM s JOIN g ON s.run = g.run AND s.loss = g.best GROUP BY s.run),
dup AS (SELECT run, count(step) - count(DISTINCT step) AS dups FROM m GROUP BY run),
x AS (SELECT g.*, best_step, dups FROM g JOIN b ON g.run = b.run JOIN dup ON g.run = dup.run),
ev AS (
  SELECT run, start_step, end_step, 'converged' AS event, 'info' AS severity FROM x WHERE early > 0 AND tail < 0.30 * early AND (tmax - tmin) / greatest(abs(tail), 1e-12) <= 0.5
  UNION ALL SELECT run, start_step, end_step, 'bad_plateau', 'warning' FROM x WHERE n >= 3 AND best_step < end_step AND tail > 2 * best AND final > 2 * best
  UNION ALL SELECT run, start_step, end_step, 'clip_storm', 'warning' FROM x WHERE clip_max > 0.5 AND final > first
  UNION ALL SELECT run, start_step, end_step, 'skip_loop', 'warning' FROM x WHERE skip_max > 0.3 OR streak > 50
  UNION ALL SELECT run, start_step, end_step, 'primary_head_failure', 'warning' FROM x WHERE n >= 2 AND hl <= 0.5 * hf AND o2 >= 0.95 * o1
  UNION ALL SELECT run, start_step, end_step, 'lr_floor_freeze', 'warning' FROM x WHERE lr_last <= lr_min * (1 + 1e-9) AND final >= 1.02 * best
  UNION ALL SELECT run, start_step, end_step, 'resume_boundary', 'info' FROM x WHERE dups > 0)
SELECT substr(sha1(concat_ws(':', CAST(run AS VARCHAR), event, CAST(start_step AS VARCHAR), CAST(end_step AS VARCHAR))), 1, 16) AS id, run, event, severity, start_step, end_step FROM ev"""


@register(
    "diagnostic_events",
    f"WITH {DEDUPED}, q AS (SELECT run, step, loss, lr, (line % 10) / 12.0 AS clip, CASE WHEN skipped THEN norm / 100 ELSE 0 END AS skip, loss / 2 AS head, norm AS other FROM d)"
    + _FEATURES.replace("SIZE", _SIZE),
)
def diagnostic_events(spark, sf_dir):
    raw = log(spark, sf_dir).select("run", "line", "step", "loss", "lr", ((F.col("line") % 10) / 12.0).alias("clip"),
                                    F.when(F.col("skipped"), F.col("norm") / 100).otherwise(0.0).alias("skip"), (F.col("loss") / 2).alias("head"),
                                    F.col("norm").alias("other"), F.lit(False).alias("resumed"))
    return rules.events(rules.features(raw))


@register("duplicate_steps", f"WITH {METRICS} SELECT run, count(*) AS n_rows, count(step) - count(DISTINCT step) AS duplicates FROM m GROUP BY run")
def duplicate_steps(spark, sf_dir):
    return log(spark, sf_dir).groupBy("run").agg(F.count(F.lit(1)).alias("n_rows"), (F.count("step") - F.count_distinct("step")).alias("duplicates"))


@register(
    "lr_schedule",
    """SELECT event_id, round(CASE WHEN event_id < 100 THEN 0.001 * (event_id + 1) / 101 WHEN event_id > 5000 THEN 0.00001
  ELSE 0.00001 + 0.5 * (1 + cos(pi() * (event_id - 100) / 4900.0)) * (0.001 - 0.00001) END, 9) AS lr FROM events""",
)
def lr_schedule(spark, sf_dir):
    from .standins import table

    return rounded(table(spark, sf_dir, "events").select("event_id", scalars.learning_rate(F.col("event_id"), 1e-3, 100, 5000, 1e-5).alias("lr")), 9)


@register(
    "running_mfu",
    f"""WITH {DEDUPED}, l AS (SELECT run, list(norm ORDER BY step) AS v FROM d GROUP BY run)
SELECT run, round(list_reduce(v, lambda a, b: 0.9 * a + 0.1 * b), 6) AS mfu FROM l""",
)
def running_mfu(spark, sf_dir):
    rows = F.transform(F.array_sort(F.collect_list(F.struct("step", "norm"))), lambda s: s["norm"])
    folded = deduped(spark, sf_dir).groupBy("run").agg(rows.alias("v"))
    value = F.aggregate(F.slice("v", 2, F.size("v")), F.get("v", F.lit(0)), lambda a, b: 0.9 * a + 0.1 * b)
    return rounded(folded.select("run", value.alias("mfu")))


@register(
    "lax_numbers",
    """WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST(value AS VARCHAR) WHEN 1 THEN 'abc' WHEN 2 THEN 'nan' WHEN 3 THEN '12.9' ELSE NULL END AS a,
  CAST(event_id AS VARCHAR) AS b FROM events),
n AS (SELECT event_id, CASE WHEN NOT isnan(TRY_CAST(a AS DOUBLE)) THEN TRY_CAST(a AS DOUBLE) END AS x, TRY_CAST(b AS DOUBLE) AS y FROM t)
SELECT event_id, coalesce(x, y) AS number, CAST(trunc(coalesce(x, y)) AS BIGINT) AS step FROM n""",
)
def lax_numbers(spark, sf_dir):
    from .standins import table

    k = F.col("event_id") % 5
    a = F.when(k == 0, F.col("value").cast("string")).when(k == 1, "abc").when(k == 2, "nan").when(k == 3, "12.9")
    b = F.col("event_id").cast("string")
    return table(spark, sf_dir, "events").select("event_id", scalars.lax_number(a, b).alias("number"), scalars.step_number(a, b).alias("step"))


@register(
    "pivot_series",
    f"""WITH {METRICS} SELECT step, arg_max(loss, CASE WHEN rank = 0 THEN line END) AS r0, arg_max(loss, CASE WHEN rank = 1 THEN line END) AS r1,
  arg_max(loss, CASE WHEN rank = 2 THEN line END) AS r2, arg_max(loss, CASE WHEN rank = 3 THEN line END) AS r3 FROM m GROUP BY step""",
)
def pivot_series(spark, sf_dir):
    from ..operators.lineage import pivoted

    m = log(spark, sf_dir).select("step", F.concat(F.lit("r"), F.col("rank").cast("string")).alias("series"), F.col("loss").alias("value"), "line")
    return pivoted(m, ["r0", "r1", "r2", "r3"])
