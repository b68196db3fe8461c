"""Token budgets, and reports over a step log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from grainmill.operators.order import with_positions


def token_budget(
    df: DataFrame, n_tokens: Column, n_loss: Column, source: str = "source"
) -> DataFrame:
    """Rows, tokens and loss-bearing tokens per source (combined before the shuffle)."""
    return df.groupBy(source).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(n_tokens.cast("bigint")).alias("n_tokens"),
        F.sum(n_loss.cast("bigint")).alias("n_loss_tokens"),
    )


def micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since 1970 of a timestamp column, by the wall clock if it has no zone."""
    if not isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        return F.unix_micros(ts)
    day = F.unix_date(F.to_date(ts)).cast("bigint")
    minutes = (day * 24 + F.hour(ts)) * 60 + F.minute(ts)
    return minutes * 60_000_000 + (F.date_part(F.lit("SECOND"), F.col(ts)) * 1_000_000).cast("bigint")


def number_steps(
    df: DataFrame, *, run: str, ts: str, tie: str, slice_seconds: int = 600
) -> DataFrame:
    """``step`` 0, 1, .. per run by time. Time slices keep one long run from one task.

    Rows without a run or a time have no step; they are kept, with a null.
    """
    known = F.col(run).isNotNull() & F.col(ts).isNotNull()
    lost = df.where(~known).withColumn("step", F.lit(None).cast("bigint"))
    df = df.where(known)
    slice_no = F.floor(micros(df, ts) / (slice_seconds * 1_000_000))
    numbered = with_positions(df, [ts, tie], slice_no, group=[run], position="step")
    return numbered.unionByName(lost)


def _no_time() -> Column:
    return F.lit(None).cast("bigint")


def interval_rows(
    df: DataFrame, every: int, *, step: str = "step", include_zero: bool = False
) -> DataFrame:
    """Rows at every ``every``-th step; step 0 only for jobs that also run at the start."""
    due = F.col(step) % every == 0
    return df.filter(due if include_zero else due & (F.col(step) > 0))


def throughput(
    steps: DataFrame, every: int, tokens_per_step: int, *, run: str = "run", step: str = "step"
) -> DataFrame:
    """Tokens per second over each finished interval of ``every`` steps of a run.

    A mark, at every ``every``-th step, ends one interval and starts the next. It is counted to
    both, and the two marks of an interval meet by (run, step): a long run is spread over tasks
    by step, and no window over a run is needed. Needs columns ``run, step, ts``.
    """
    marks = interval_rows(steps, every, step=step, include_zero=True).select(
        run, step, micros(steps, "ts").alias("at")
    )
    ends = F.struct(F.col(step).alias(step), F.col("at").alias("ended"), _no_time().alias("started"))
    starts = F.struct(
        (F.col(step) + every).alias(step), _no_time().alias("ended"), F.col("at").alias("started")
    )
    seconds = (F.col("ended") - F.col("started")) / F.lit(1e6)
    return (
        marks.select(run, F.explode(F.array(ends, starts)).alias("mark"))
        .select(run, "mark.*")
        .groupBy(run, step)
        .agg(F.max("ended").alias("ended"), F.max("started").alias("started"))
        .filter(F.col("ended").isNotNull() & F.col("started").isNotNull())
        .select(
            run,
            step,
            seconds.alias("seconds"),
            (F.lit(float(every * tokens_per_step)) / F.nullif(seconds, F.lit(0.0))).alias(
                "tokens_per_second"
            ),
        )
    )
