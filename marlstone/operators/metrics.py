"""Operators over step-wise metric logs: ``run``, ``line`` (file order), ``step``, values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the last in file order; rows with a null key go."""
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return df.withColumn("rank__", rank).where("rank__ = 1").drop("rank__")


def last_known(df: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """Per key the last non-null of each value: the variant for logs where later
    rows of a step leave values out."""
    return df.groupBy(*keys).agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(v) for v in values])


def first_first(n: Column, rank: Column, size: Column | int) -> Column:
    return rank <= F.least(F.lit(size) if isinstance(size, int) else size, n)


def window_size(n: Column) -> Column:
    """How many points the first and the last window of a series have."""
    tenth = F.floor(n / 10)
    return F.least(F.lit(100), F.greatest(F.lit(3), F.when(tenth == 0, 1).otherwise(tenth))).cast("bigint")


def summarise(df: DataFrame, edge: int = 10) -> DataFrame:
    """Per run: best, final, early and tail loss, gradient norm percentiles and
    action counts. ``df``: deduplicated ``run, step, loss, norm, clipped, skipped``."""
    has = F.col("loss").isNotNull()
    up, down = Window.partitionBy("run", has).orderBy("step"), Window.partitionBy("run", has).orderBy(F.desc("step"))
    ranked = df.withColumn("a__", F.when(has, F.row_number().over(up))).withColumn("z__", F.when(has, F.row_number().over(down)))
    best = F.min(F.when(has, F.struct("loss", "step")))
    q = F.percentile("norm", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return ranked.groupBy("run").agg(
        F.count(F.lit(1)).alias("row_count"),
        best["loss"].alias("best_loss"),
        best["step"].alias("best_step"),
        F.max_by("loss", F.when(has, F.col("step"))).alias("final_loss"),
        F.avg(F.when(F.col("a__") <= edge, F.col("loss"))).alias("early_loss"),
        F.avg(F.when(F.col("z__") <= edge, F.col("loss"))).alias("tail_loss"),
        F.get(q, F.lit(0)).alias("norm_p50"),
        F.get(q, F.lit(1)).alias("norm_p95"),
        F.get(q, F.lit(2)).alias("norm_p99"),
        F.max("norm").alias("norm_max"),
        F.count_if(F.col("clipped") > 0).alias("clip_count"),
        F.count_if(F.col("skipped") > 0).alias("skip_count"),
        F.avg("clipped").alias("clip_mean"),
        F.avg("skipped").alias("skip_mean"),
    )


def downsample(df: DataFrame, most: int, run: str = "run", step: str = "step") -> DataFrame:
    """Every k-th point, and the last; ``aggregation`` says raw or stride."""
    by = Window.partitionBy(run)
    n, i = F.count(F.lit(1)).over(by), F.row_number().over(by.orderBy(step)) - 1
    stride = F.ceil(F.col("n__") / most)
    return (
        df.withColumn("n__", n)
        .withColumn("i__", i)
        .where((F.col("n__") <= most) | (F.pmod(F.col("i__"), F.greatest(stride, F.lit(1))) == 0) | (F.col("i__") == F.col("n__") - 1))
        .withColumn("aggregation", F.when(F.col("n__") <= most, F.lit("raw")).otherwise(F.lit("stride")))
        .drop("n__", "i__")
    )


def ordered(run: str = "run", step: str = "step") -> Window:
    return Window.partitionBy(run).orderBy(step)


def rolling_rate(flag: Column, rows: int = 100, w=None) -> Column:
    return F.avg(flag.cast("double")).over((w or ordered()).rowsBetween(1 - rows, 0))


def running(flag: Column, w=None) -> Column:
    return F.sum(flag.cast("bigint")).over((w or ordered()).rowsBetween(Window.unboundedPreceding, 0))


def filled(value: Column, start: Column, w=None) -> Column:
    return F.coalesce(F.last(value, ignorenulls=True).over((w or ordered()).rowsBetween(Window.unboundedPreceding, 0)), start)


def with_streaks(df: DataFrame, flag: Column, name: str = "streak", run: str = "run", step: str = "step") -> DataFrame:
    """Length of the run of true flags that ends at each row."""
    w = ordered(run, step).rowsBetween(Window.unboundedPreceding, 0)
    broken = df.withColumn("f__", F.when(flag, 1).otherwise(0)).withColumn("g__", F.sum(1 - F.col("f__")).over(w))
    inner = Window.partitionBy(run, "g__").orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    return broken.withColumn(name, F.sum("f__").over(inner).cast("bigint")).drop("f__", "g__")


def smoothed(df: DataFrame, value: str, width: int, run: str = "run", step: str = "step") -> DataFrame:
    """Centred moving mean with the edge values repeated; series shorter than
    the width stay."""
    p = width // 2
    q = width - 1 - p
    by = Window.partitionBy(run)
    w = by.orderBy(step)
    all_ = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    i, n = F.row_number().over(w) - 1, F.count(F.lit(1)).over(by)
    padded = (
        F.sum(value).over(w.rowsBetween(-p, q))
        + F.greatest(F.lit(0), p - i) * F.first(value).over(all_)
        + F.greatest(F.lit(0), i + q - (n - 1)) * F.last(value).over(all_)
    ) / width
    return df.withColumn("smooth", F.when(n < width, F.col(value)).otherwise(padded))


def interval_means(df: DataFrame, windows: DataFrame) -> DataFrame:
    """Means of the rows with ``lo < step <= hi`` for each window; windows may
    overlap and empty ones stay. A window list is a handful of rows."""
    inside = (df["step"] > windows["lo"]) & (df["step"] <= windows["hi"])
    joined = windows.join(df, inside, "left")
    ratio = F.when(F.col("clipped") & (F.col("norm") > 0), F.col("threshold") / F.col("norm"))
    return joined.groupBy("window", "lo", "hi").agg(
        F.count("step").alias("n_rows"),
        F.avg("loss").alias("mean_loss"),
        F.avg("norm").alias("mean_norm"),
        F.avg("lr").alias("mean_lr"),
        F.try_divide(F.count_if(F.col("clipped")), F.count("norm")).alias("clip_rate"),
        F.avg(ratio).alias("mean_clip_ratio"),
    )


def category_shares(df: DataFrame, column: str, categories: list[str]) -> DataFrame:
    """Count and percentage of each of a fixed list, zeros included."""
    names = df.sparkSession.createDataFrame([(c,) for c in categories], f"{column} string")
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return names.join(counts, column, "left").crossJoin(total).select(
        column, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.try_divide(100.0 * F.coalesce("n", F.lit(0)), "total"), F.lit(0.0)).alias("percent")
    )


def window_drop(df: DataFrame, value: str, run: str = "run", step: str = "step", size: int | None = None, folded: bool = False) -> DataFrame:
    """Mean of the first and of the last window of each run and the share lost.
    ``size``: values in a window, where it doesn't follow from the series. ``folded``:
    a window is added up from its latest value back, whatever order rows come in, so
    that means agree to the last bit."""
    has = df.where(F.col(value).isNotNull())
    by = Window.partitionBy(run)
    ranked = has.withColumn("n__", F.count(F.lit(1)).over(by)).withColumn("a__", F.row_number().over(by.orderBy(step)))
    size = window_size(F.col("n__")) if size is None else F.lit(size)

    def mean(inside: Column) -> Column:
        if not folded:
            return F.avg(F.when(inside, F.col(value)))
        rows = F.sort_array(F.collect_list(F.when(inside, F.struct("a__", F.col(value).cast("double").alias("v")))), asc=False)
        return F.aggregate(rows, F.lit(0.0), lambda total, x: total + x["v"]) / F.nullif(F.size(rows), F.lit(0))

    out = ranked.groupBy(run).agg(
        F.max("n__").alias("n"),
        mean(F.col("a__") <= size).alias("first_mean"),
        mean(F.col("a__") > F.col("n__") - size).alias("last_mean"),
    )
    return out.withColumn("drop", (F.col("first_mean") - F.col("last_mean")) / F.greatest(F.abs("first_mean"), F.lit(1e-12)))


def reduced_over_ranks(df: DataFrame) -> DataFrame:
    return df.groupBy("step").agg(
        F.count(F.lit(1)).alias("ranks"),
        F.avg("loss").alias("loss_mean"),
        F.min("loss").alias("loss_min"),
        F.max("loss").alias("loss_max"),
        F.avg("step_ms").alias("step_ms_mean"),
        F.max("step_ms").alias("step_ms_max"),
        F.max("load_s").alias("load_s_max"),
        F.sum("samples_per_s").alias("samples_per_s"),
        F.sum("tokens_per_s").alias("tokens_per_s"),
    )


def health(df: DataFrame, skip_share: float = 0.5, streak: int = 10, norm_limit: float = 50.0, worse: float = 1.5) -> DataFrame:
    """Trip wires of a run: too many skips, a long streak, a huge norm, a loss
    that ends far above its start. ``df``: ``run, step, loss, norm, skipped``."""
    marked = with_streaks(df, F.col("skipped"))
    has = F.col("loss").isNotNull()
    out = marked.groupBy("run").agg(
        F.avg(F.col("skipped").cast("int")).alias("skip_share"),
        F.max("streak").alias("longest_streak"),
        F.max("norm").alias("norm_max"),
        F.min_by("loss", F.when(has, F.col("step"))).alias("first_loss"),
        F.max_by("loss", F.when(has, F.col("step"))).alias("last_loss"),
    )
    trips = {
        "too_many_skips": F.col("skip_share") > skip_share,
        "long_streak": F.col("longest_streak") >= streak,
        "huge_norm": F.col("norm_max") >= norm_limit,
        "worse_loss": F.col("last_loss") > worse * F.col("first_loss"),
    }
    for name, cond in trips.items():
        out = out.withColumn(name, F.coalesce(cond, F.lit(False)))
    any_ = None
    for name in trips:
        any_ = F.col(name) if any_ is None else any_ | F.col(name)
    return out.withColumn("unhealthy", any_)


def extremes(df: DataFrame) -> DataFrame:
    """Per run the extremes of its norms and thresholds, and the limits as first
    stated. ``df``: raw rows ``run, line, raw, ema, clip_at, skip_at, skip_max, hard_limit``."""
    stated = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line"))).alias(c)
    return df.groupBy("run").agg(
        F.max("raw").alias("raw_max"),
        F.max("ema").alias("ema_max"),
        F.max("clip_at").alias("clip_at_max"),
        F.min("skip_at").alias("skip_at_min"),
        F.max("skip_at").alias("skip_at_max"),
        stated("skip_max"),
        stated("hard_limit"),
    )


def stability(df: DataFrame, skip_share: float = 0.5, streak: int = 50, worse: float = 1.5, span: int = 4000, window: int = 25, least_drop: float = 0.5, most_zero: float = 0.65) -> DataFrame:
    """Six trip wires of a run in file order: too many norm skips, a long streak of
    skips, a raw norm at the stated skip maximum or hard limit, a loss that ends far
    above its start, and a primary task that doesn't learn: the first head loses less
    than ``least_drop`` between its first and last ``window`` values or the zero head ends over
    ``most_zero``, judged from ``span`` steps on.

    ``df``: the rows of :func:`extremes` with ``step, loss, action, skipped, head,
    zero``. Rows without a raw norm neither lengthen nor end a streak; a limit of zero
    or below, or none, never trips; a head that never occurs isn't judged."""
    skip = F.coalesce(F.col("skipped"), F.lit(False)) | F.coalesce(F.col("action").isin("skip_norm", "skip_nan"), F.lit(False))
    longest = with_streaks(df.where("raw is not null"), skip, "s__", step="line").groupBy("run").agg(F.max("s__").alias("longest_streak"))
    at = lambda f, c: f(c, F.when(F.col(c).isNotNull(), F.col("line")))
    ends = df.groupBy("run").agg(
        (F.count_if(F.col("action") == "skip_norm") / F.count(F.lit(1))).alias("skip_share"),
        at(F.min_by, "loss").alias("first_loss"),
        at(F.max_by, "loss").alias("last_loss"),
        (at(F.max_by, "step") - at(F.min_by, "step") + 1).alias("span__"),
    )
    head = window_drop(df, "head", step="line", size=window, folded=True).select("run", F.col("drop").alias("head_drop"))
    zero = window_drop(df, "zero", step="line", size=window, folded=True).select("run", F.col("last_mean").alias("zero_last"))
    out = ends.join(extremes(df), "run")
    for more in (longest, head, zero):
        out = out.join(more, "run", "left")
    over = lambda limit: (F.col(limit) > 0) & (F.col("raw_max") >= F.col(limit))
    stuck = F.coalesce(F.col("head_drop") < least_drop, F.lit(False)) | F.coalesce(F.col("zero_last") > most_zero, F.lit(False))
    trips = {
        "too_many_skips": F.col("skip_share") > skip_share,
        "long_streak": F.col("longest_streak") >= streak,
        "over_skip_max": over("skip_max"),
        "over_hard_limit": over("hard_limit"),
        "worse_loss": F.col("last_loss") > worse * F.col("first_loss"),
        "primary_stuck": (F.col("span__") >= span) & stuck,
    }
    out = out.withColumns({name: F.coalesce(cond, F.lit(False)) for name, cond in trips.items()}).drop("span__")
    return out.withColumn("unhealthy", F.greatest(*trips))
