"""Model files to SI tables in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.model import assemble_model
from ..sources.model_text import entity_tables, read_entities


def import_models(spark: SparkSession, path: str | list[str]) -> dict[str, DataFrame]:
    entities, lines = read_entities(spark, path)
    return assemble_model(entity_tables(entities, lines))
