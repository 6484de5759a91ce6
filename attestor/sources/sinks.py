"""Reports from result tables: JSON without secrets, CSV, Markdown, graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions.ids import mask
from attestor.functions.redaction import redacted_json
from attestor.functions.text import SECRETS, sensitive_key


def redacted(text: Column) -> Column:
    """A text with all forms of secrets masked: the whole of bare keys, the value after a name."""
    out = text
    for name, pattern in SECRETS.items():
        groups = {"assigned": "$1$2****", "query": "$1****", "session": "$1=****", "cookie": "$1$2****"}.get(name, "****")
        out = F.regexp_replace(out, pattern, groups)
    return out


def masked_map(m: Column) -> Column:
    """A map whose values under sensitive keys are masked."""
    return F.transform_values(m, lambda k, v: F.when(sensitive_key(k), mask(v)).otherwise(v))


def stripped_map(m: Column) -> Column:
    """A map without its sensitive keys."""
    return F.map_filter(m, lambda k, v: ~sensitive_key(k))


def json_lines(rows: DataFrame) -> DataFrame:
    """Rows as JSON, with values under sensitive keys masked at any depth and all texts redacted."""
    return rows.select(redacted_json(F.to_json(F.struct(*rows.columns))).alias("value"))


def csv_rows(entities: DataFrame) -> DataFrame:
    """type, value, confidence, source and tags, the tags in their order, joined by commas."""
    return entities.select("type", "value", "confidence", "source", F.array_join("tags", ",").alias("tags"))


def markdown(scores: DataFrame) -> DataFrame:
    """A case's scores as lines of Markdown, in order."""
    lines = F.array(
        F.concat(F.lit("# Case "), F.col("case_id").cast("string")),
        F.concat(F.lit("- Confidence: "), F.col("confidence_score").cast("string")),
        F.concat(F.lit("- Risk: "), F.col("risk_score").cast("string"), F.lit(" ("), F.col("risk_level"), F.lit(")")),
        F.concat(F.lit("- Reputation: "), F.col("reputation_score").cast("string")),
    )
    return scores.select("case_id", F.posexplode(lines).alias("line_no", "line"))


def write(rows: DataFrame, path: str, fmt: str = "parquet", **options: str) -> None:
    """Writes in any format that Spark writes; a run's rows are added, never changed."""
    rows.write.mode("append").format(fmt).options(**options).save(path)
