"""Checks of operation settings, as a job over a table of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.schema import ALGORITHMS, LOG_LEVELS, SETTINGS_ALGORITHMS


def _problem(field: str, bad: Column, message: Column | str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(
        F.coalesce(bad, F.lit(False)),
        F.struct(
            F.lit(field).alias("field"), text.alias("message"),
            F.col(field).cast("string").alias("value"),
        ),
    )


def _reported(configs: DataFrame, problems: list[Column]) -> DataFrame:
    return configs.select("id", F.explode(F.array_compact(F.array(*problems))).alias("p")).select(
        "id", "p.*"
    )


def audit_configs(configs: DataFrame) -> DataFrame:
    """All violations, one row each, of operation settings (id, operation_type,
    parallelism, min_file_size, max_file_size, similarity_threshold, hash_algorithm,
    target_user)."""
    low, high = F.col("min_file_size"), F.col("max_file_size")
    sim, alg = F.col("similarity_threshold"), F.col("hash_algorithm")
    return _reported(
        configs,
        [
            _problem("parallelism", F.col("parallelism") < 0, "parallelism cannot be negative"),
            _problem("min_file_size", (high > 0) & (low > 0) & (low > high),
                     "min file size cannot be greater than max file size"),
            _problem("similarity_threshold", (sim < 0) | (sim > 1),
                     "similarity threshold must be between 0.0 and 1.0"),
            _problem("hash_algorithm", (alg != "") & ~alg.isin(*ALGORITHMS),
                     F.concat(F.lit("unsupported hash algorithm: "), alg)),
            _problem("operation_type",
                     (F.col("operation_type") == "ownership") & F.col("target_user").isNull(),
                     "target_user parameter is required"),
        ],
    )


def audit_settings(settings: DataFrame) -> DataFrame:
    """Violations of settings files (id, hash_algorithm, duplicate_threshold,
    similarity_threshold, log_level)."""
    def outside(c: str) -> Column:
        return (F.col(c) < 0) | (F.col(c) > 1)

    return _reported(
        settings,
        [
            _problem("hash_algorithm", ~F.col("hash_algorithm").isin(*SETTINGS_ALGORITHMS),
                     F.concat(F.lit("invalid hash algorithm: "), "hash_algorithm")),
            _problem("duplicate_threshold", outside("duplicate_threshold"),
                     "duplicate_threshold must be between 0.0 and 1.0"),
            _problem("similarity_threshold", outside("similarity_threshold"),
                     "similarity_threshold must be between 0.0 and 1.0"),
            _problem("log_level", ~F.lower("log_level").isin(*LOG_LEVELS),
                     F.concat(F.lit("invalid log level: "), "log_level")),
        ],
    )
