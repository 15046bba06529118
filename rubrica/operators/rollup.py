"""Repository rollups and the CI gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubrica.config import EXIT_BELOW, EXIT_OK, GRADES, Config, UserError
from rubrica.operators.scoring import grade_floor, grade_rank


def worst_grade(cards: DataFrame, *by: str) -> DataFrame:
    """(by, overall, artifacts, worst_composite): the weakest grade of each group."""
    return cards.groupBy(*by).agg(F.max_by("grade", grade_rank(F.col("grade"))).alias("overall"), F.count(F.lit(1)).alias("artifacts"), F.min("composite").alias("worst_composite"))


def meets(grade: Column, threshold: str) -> Column:
    return grade_floor(grade) >= grade_floor(F.lit(threshold))


def gate(cards: DataFrame, threshold: str | None = None, config: Config | None = None) -> DataFrame:
    """Cards that fail the gate: below the threshold (the flag, else the config's, else B), or F whatever the threshold."""
    limit = threshold or (config.threshold if config else "B")
    if limit not in GRADES:
        raise UserError(f'unknown grade "{limit}"')
    return cards.where(~meets(F.col("grade"), limit) | (F.col("grade") == "F"))


def exit_code(cards: DataFrame, threshold: str | None = None, config: Config | None = None) -> int:
    return EXIT_BELOW if gate(cards, threshold, config).limit(1).count() else EXIT_OK
