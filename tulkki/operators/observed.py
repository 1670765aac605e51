"""A9 and P6 in the pass that computes the result: counts as observed metrics, warnings on rows that stay.

``DataFrame.observe`` collects its aggregates while the rows go by, so that a
run has its counts (records, rejects by reason, warnings by kind) as soon as
it is written, without a second job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Why a record is a reject, and what a record that stays may be flagged for.
REASONS = ("missing_reference", "invalid_line_index", "empty_prediction", "too_long", "unknown_language", "unsupported_pair", "missing_input")
WARNINGS = ("count_mismatch", "unparsed_metadata", "empty_reference", "missing_prediction")


def warned(*checks: tuple[Column, str]) -> Column:
    """The names of all checks that hold, as an array; rows with warnings stay."""
    names = F.array(*[F.when(cond, F.lit(name)) for cond, name in checks])
    return F.filter(names, lambda x: x.isNotNull())


def observed(df: DataFrame, name: str, reason: str = "reject_reason", warnings: str = "warnings",
             reasons: tuple[str, ...] = REASONS, kinds: tuple[str, ...] = WARNINGS) -> tuple[DataFrame, Observation]:
    """``df`` and the counts of the job that will read it: n, accepted, rejected, other_reasons, reject_<reason>, warned and warning_<kind>.

    Only columns that ``df`` has are counted.  The counts are there
    (``Observation.get``) when an action on the returned DataFrame has
    finished; a task that is repeated counts once.
    """
    counts = [F.count(F.lit(1)).alias("n")]
    if reason in df.columns:
        counts += [F.count_if(F.col(reason).isNull()).alias("accepted"), F.count_if(F.col(reason).isNotNull()).alias("rejected"),
                   F.count_if(F.col(reason).isNotNull() & ~F.col(reason).isin(*reasons)).alias("other_reasons")]
        counts += [F.count_if(F.col(reason) == r).alias(f"reject_{r}") for r in reasons]
    if warnings in df.columns:
        counts += [F.count_if(F.size(warnings) > 0).alias("warned")]
        counts += [F.count_if(F.array_contains(warnings, k)).alias(f"warning_{k}") for k in kinds]
    run = Observation(name)
    return df.observe(run, *counts), run
