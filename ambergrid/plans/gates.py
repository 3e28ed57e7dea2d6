"""Roll-up of checks into one verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

PASSED, SKIPPED = "PASS_TEST", "SKIP_OPTIONAL_TEST_MISSING"


def summary(checks: DataFrame) -> DataFrame:
    """Counts of required and optional checks by outcome, and ``passed``, in one row.

    checks: status, required. All required ones must pass; optional ones may be skipped. A null status is a failure; no
    checks pass.
    """
    required, status = F.coalesce("required", F.lit(False)), F.coalesce("status", F.lit(""))
    good, skipped = status == PASSED, status == SKIPPED
    kinds = {
        "required_total": required,
        "required_pass": required & good,
        "required_fail_or_missing": required & ~good,
        "optional_total": ~required,
        "optional_pass": ~required & good,
        "optional_skipped": ~required & skipped,
    }
    counted = checks.agg(*[F.count_if(c).alias(n) for n, c in kinds.items()])
    fine = (F.col("required_fail_or_missing") == 0) & (F.col("optional_total") == F.col("optional_pass") + F.col("optional_skipped"))
    return counted.withColumn("passed", fine)
