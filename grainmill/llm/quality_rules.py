"""Quality rules whose limits adapt to each language and source.

Each measure of a document is put into a narrow value bucket, and counts by (language, source,
measure, bucket) are the quantile sketch: counts of any two parts add up, the result does not
depend on the order of merging, and a quantile is right to one bucket. Sums are combined before
the exchange, so a source with a third of all rows sends as many counts as any other. The limit
of a measure is its median plus a multiple of the spread of its quieter half, so that junk in
the upper tail does not widen it. Limits are joined back by language and source.

Only documents that pass the base rules enter the sketches. Nulls and odd cases: a null text is
an empty one, has no words and fails the base rules; null languages and sources are groups of
their own; repeated rows count each; a group of one document keeps it, as it is its own median;
an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from grainmill.llm import words as W
from grainmill.llm.docstats import document_counts

LEAST_WORDS = 50
MOST_REPEATED = 0.5


@dataclass(frozen=True)
class Measure:
    """``value`` in buckets of ``step``; limits are at least ``slack`` away from the median."""

    value: str
    step: float
    slack: float
    both_sides: bool = False


MEASURES = {
    "word_length": Measure("word_chars / n_words", 0.02, 2.0, both_sides=True),
    "symbols": Measure("n_symbols / n_words", 0.005, 0.2),
    "dup_lines": Measure("n_dup_lines / greatest(n_lines, 1)", 0.01, 0.55),
    "repeats": Measure("n_repeat_words / n_words", 0.01, 0.45),
    "capitals": Measure("n_upper / greatest(n_upper + n_lower, 1)", 0.005, 0.3),
    "loud": Measure("n_loud / n_words", 0.005, 0.25),
}
SPREADS = 8.0
QUIET = 0.1


def base_failed(least_words: int = LEAST_WORDS) -> Column:
    return (F.col("n_words") < least_words) | (
        100 * F.col("n_repeat_words") > 50 * F.col("n_words")
    )


def value_buckets(counts: DataFrame, measures: dict[str, Measure]) -> DataFrame:
    """The sketch: ``lang, source, measure, bucket, n`` of the documents that pass the base."""
    cells = F.array(
        *[
            F.struct(F.lit(name).alias("measure"), F.floor(F.expr(m.value) / m.step).alias("bucket"))
            for name, m in measures.items()
        ]
    )
    return (
        counts.where(~F.col("base_failed"))
        .select("lang", "source", F.explode(cells).alias("cell"))
        .groupBy("lang", "source", "cell.measure", "cell.bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def limits(sketch: DataFrame, measures: dict[str, Measure], spreads: float, quiet: float) -> DataFrame:
    """``lang, source`` and the lowest and highest bucket of each measure."""
    group = ["lang", "source", "measure"]
    upto = Window.partitionBy(*group).orderBy("bucket")
    whole = Window.partitionBy(*group)
    ranked = sketch.withColumn("_upto", F.sum("n").over(upto)).withColumn("_all", F.sum("n").over(whole))

    def quantile(q: float) -> Column:
        return F.min(F.when(F.col("_upto") >= q * F.col("_all"), F.col("bucket")))

    rows = ranked.groupBy(*group).agg(
        quantile(0.5).alias("middle"), quantile(quiet).alias("low"), quantile(1 - quiet).alias("high")
    )
    out = []
    for name, m in measures.items():
        mine = F.col("measure") == name
        least = int(round(m.slack / m.step))
        # One-sided measures widen by their lower half, the side that junk does not reach.
        spread = F.col("middle") - F.col("low")
        if m.both_sides:
            spread = F.least(spread, F.col("high") - F.col("middle"))
        room = F.greatest(spreads * spread, F.lit(least))
        out.append(F.max(F.when(mine, F.col("middle") + room)).alias(f"_high_{name}"))
        out.append(F.max(F.when(mine & F.lit(m.both_sides), F.col("middle") - room)).alias(f"_low_{name}"))
    return rows.groupBy("lang", "source").agg(*out)


def judge_documents(
    docs: DataFrame,
    *,
    measures: dict[str, Measure] | None = None,
    spreads: float = SPREADS,
    quiet: float = QUIET,
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """Counts of each document, ``base_failed``, ``broken`` (measures out of limits), ``kept``."""
    measures = measures or MEASURES
    counts = W.bounded_rows(
        document_counts(docs).withColumn("base_failed", base_failed(least_words)), "rule-counts"
    )
    table = limits(value_buckets(counts, measures), measures, spreads, quiet)
    table = table.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    joined = counts.join(
        table,
        F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")),
        "left",
    )
    broken = F.array_compact(
        F.array(
            *[
                F.when(
                    (F.floor(F.expr(m.value) / m.step) > F.col(f"_high_{name}"))
                    | F.coalesce(F.floor(F.expr(m.value) / m.step) < F.col(f"_low_{name}"), F.lit(False)),
                    F.lit(name),
                )
                for name, m in measures.items()
            ]
        )
    )
    broken = F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(broken)
    return (
        joined.withColumn("broken", broken)
        .withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))
        .select(*counts.columns, "broken", "kept")
    )
