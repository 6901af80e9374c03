"""Replay of an adaptive gradient clipping controller.

A recurrence that no window function has: per run, rows in step order are folded
with the running mean of the norm as state. The fold runs inside the JVM and
stays as it is once a check has stopped the run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# The controller's defaults.
@dataclass(frozen=True)
class Settings:
    static_clip: float = 0.5
    beta: float = 0.98
    clip_ratio: float = 3.0
    skip_ratio: float = 100.0
    skip_max: float = 100_000_000_000.0
    clip_min: float = 0.5
    clip_max: float = 1000.0
    warm: int = 200
    most_skips: int = 50
    runaway: float = 2.0
    hard_limit: float = 100_000_000_000.0

    @property
    def cap(self) -> float:
        """What one row may add to the mean at most; 0: no bound."""
        return self.skip_max / self.skip_ratio if self.skip_max > 0 and self.skip_ratio > 0 else 0.0


STATE = (
    ("observed", "bigint"), ("ema", "double"), ("ema_max", "double"), ("passed", "bigint"), ("clipped", "bigint"), ("skipped", "bigint"), ("skips_in_row", "bigint"),
    ("clips_in_row", "bigint"), ("longest_skips", "bigint"), ("longest_clips", "bigint"), ("aborted_at", "bigint"), ("reason", "string"),
)


def _state(*cols) -> Column:
    return F.struct(*[c.cast(kind).alias(name) for c, (name, kind) in zip(cols, STATE)])


def step(s: Column, x: Column, p: Settings) -> Column:
    """State after one row ``x(step, norm)``."""
    big = F.lit(float("inf"))
    norm, ema = x["norm"], s["ema"]
    finite = ~F.isnan(norm) & (F.abs(norm) < big)
    ready = (s["observed"] >= p.warm) & (s["observed"] > 0)
    clip = F.when(ready, F.greatest(F.lit(p.clip_min), F.least(F.lit(p.clip_max), ema * p.clip_ratio))).otherwise(F.lit(p.static_clip))
    late = ema * p.skip_ratio if p.skip_ratio > 0 else big
    skip = F.when(ready, F.least(late, F.lit(p.skip_max)) if p.skip_max > 0 else late).otherwise(big)
    if p.hard_limit > 0:
        skip = F.least(skip, F.lit(p.hard_limit))
    skips = ~finite | (norm > skip)
    clips = ~skips & (norm > clip)
    given = F.when(s["observed"] == 0, norm).otherwise(F.least(norm, ema * p.clip_ratio))
    if p.cap > 0:
        given = F.least(given, F.lit(p.cap))
    mean = F.when(skips, ema).when(s["observed"] == 0, given).otherwise(p.beta * ema + (1.0 - p.beta) * given)
    one = lambda c: F.when(c, 1).otherwise(0)
    in_row = F.when(skips, s["skips_in_row"] + 1).otherwise(F.lit(0))
    clip_row = F.when(clips, s["clips_in_row"] + 1).otherwise(F.lit(0))
    known = s["observed"] + one(~skips) > 0
    reason = (
        F.when(F.lit(p.hard_limit > 0) & finite & (norm > p.hard_limit), "hard_limit")
        .when(F.lit(p.most_skips > 0) & (in_row >= p.most_skips), "skips_in_row")
        .when(F.lit(p.runaway > 0 and p.cap > 0) & known & (mean > p.cap * p.runaway), "runaway")
    )
    after = _state(
        s["observed"] + one(~skips), mean, F.greatest(s["ema_max"], F.when(skips, s["ema_max"]).otherwise(mean)), s["passed"] + one(~skips & ~clips), s["clipped"] + one(clips),
        s["skipped"] + one(skips), in_row, clip_row, F.greatest(s["longest_skips"], in_row), F.greatest(s["longest_clips"], clip_row), F.when(reason.isNotNull(), x["step"]), reason,
    )
    return F.when(s["reason"].isNotNull(), s).otherwise(after)


def replay(df: DataFrame, settings: Settings = Settings(), run: str = "run") -> DataFrame:
    """``df(run, step, norm)`` -> final state per run; rows without a norm are
    left out, NaN and infinite ones are skips. One run's points are held in one row."""
    rows = F.array_sort(F.collect_list(F.struct("step", "norm")))
    start = _state(*[F.lit(None) if name in ("aborted_at", "reason") else F.lit(0) for name, _ in STATE])
    folded = df.where("norm is not null").groupBy(run).agg(rows.alias("rows"))
    return folded.select(run, F.aggregate("rows", start, lambda s, x: step(s, x, settings)).alias("s")).select(run, "s.*")


def next_state(s: tuple, at: int, norm: float, p: Settings) -> tuple:
    """The same in plain Python, for the stateful stream; a tuple in the order of
    ``STATE`` with -1 and the empty text for none."""
    observed, ema, top, passed, clipped, skipped, skip_row, clip_row, most_skip, most_clip, aborted, reason = s
    if reason:
        return s
    inf = float("inf")
    finite = norm == norm and abs(norm) < inf
    ready = observed >= p.warm and observed > 0
    clip = max(p.clip_min, min(p.clip_max, ema * p.clip_ratio)) if ready else p.static_clip
    skip = inf
    if ready:
        skip = ema * p.skip_ratio if p.skip_ratio > 0 else inf
        skip = min(skip, p.skip_max) if p.skip_max > 0 else skip
    skip = min(skip, p.hard_limit) if p.hard_limit > 0 else skip
    skips = not finite or norm > skip
    clips = not skips and norm > clip
    if not skips:
        given = norm if observed == 0 else min(norm, ema * p.clip_ratio)
        given = min(given, p.cap) if p.cap > 0 else given
        ema = given if observed == 0 else p.beta * ema + (1.0 - p.beta) * given
        observed, top = observed + 1, max(top, ema)
    skip_row, clip_row = (skip_row + 1 if skips else 0), (clip_row + 1 if clips else 0)
    if p.hard_limit > 0 and finite and norm > p.hard_limit:
        reason = "hard_limit"
    elif 0 < p.most_skips <= skip_row:
        reason = "skips_in_row"
    elif p.runaway > 0 and p.cap > 0 and observed and ema > p.cap * p.runaway:
        reason = "runaway"
    return (observed, ema, top, passed + (not skips and not clips), clipped + clips, skipped + skips, skip_row, clip_row, max(most_skip, skip_row), max(most_clip, clip_row),
            at if reason else aborted, reason)


START = (0, 0.0, 0.0, 0, 0, 0, 0, 0, 0, 0, -1, "")
