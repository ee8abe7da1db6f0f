"""Schemas of the bitext rows at each stage, and their checks.

Columns are named source_text, target_text and so on inside the engine; to_dotted and
from_dotted rename from and to the `source.text` form of files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType, StringType, StructField, StructType

_SIDES = ("source", "target")


def _struct(**fields) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


INGESTED = _struct(
    source_nllb_code=StringType(), target_nllb_code=StringType(), source_text=StringType(), target_text=StringType(),
    source_lid=FloatType(), target_lid=FloatType(), source_url=StringType(), target_url=StringType(),
    source_source=StringType(), target_source=StringType(), laser_score=FloatType(), dataset=StringType(), id=StringType(),
)
LENGTH_FILTERED = StructType([INGESTED[c] for c in ("source_nllb_code", "target_nllb_code", "source_text", "target_text", "source_lid", "target_lid", "dataset")])
LID_SCORED = StructType([*LENGTH_FILTERED.fields, StructField("source_lid_predicted", StringType()), StructField("target_lid_predicted", StringType())])
FINAL = StructType([INGESTED[c] for c in ("source_nllb_code", "target_nllb_code", "source_text", "target_text")])


def assert_schema(df: DataFrame, schema: StructType) -> DataFrame:
    """df, if it has every column of schema in that type; else a ValueError that names what is missing."""
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f"{f.name}: {f.dataType.simpleString()}" for f in schema if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError("missing or of another type: " + ", ".join(wrong))
    return df


def to_dotted(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).alias(c.replace("_", ".", 1) if c.split("_")[0] in _SIDES else c) for c in df.columns])


def from_dotted(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(c.replace(".", "_", 1) if c.split(".")[0] in _SIDES else c) for c in df.columns])
