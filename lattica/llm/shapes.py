"""Result schemas of operators that run over Arrow batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string


def with_id(df: DataFrame, id_col: str, rest: str) -> tuple[StructType, pa.Schema]:
    """The id column as the input has it, then the columns of a DDL string; for Spark and for Arrow."""
    out = StructType([StructField(id_col, df.schema[id_col].dataType), *_parse_datatype_string(rest).fields])
    return out, to_arrow_schema(out)


def plain(ddl: str) -> tuple[StructType, pa.Schema]:
    out = _parse_datatype_string(ddl)
    return out, to_arrow_schema(out)
