"""Small fixed tables as literals inside the plan."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def constant_rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A frame of literal rows that the optimizer folds; no data is shipped from Python."""
    struct = T.StructType.fromDDL(schema)
    text = json.dumps([dict(zip(struct.names, row)) for row in rows], ensure_ascii=False)
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), T.ArrayType(struct))))
