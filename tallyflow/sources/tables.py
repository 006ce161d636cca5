"""Result tables as text and Parquet: readers, writers and schemas."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyflow.schema import require_schema
from tallyflow.session import cut_lineage

# Kinds of arithmetic columns that are floating point.
FLOAT_KINDS = ("float", "double", "long double")

_CSV = {"header": False, "nullValue": "", "mode": "FAILFAST"}


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType, header: bool = False) -> DataFrame:
    """A CSV file as one declared table."""
    return spark.read.options(**_CSV).option("header", header).schema(schema).csv(path)


def read_csvrel(spark: SparkSession, path: str, schemas: Mapping[str, T.StructType]) -> dict[str, DataFrame]:
    """Text lines ``table,field,…`` as one DataFrame per declared table.

    Each table filters the lines by prefix before parsing; a table that the file
    has and ``schemas`` lacks is simply not returned.
    """
    lines = spark.read.text(path)
    out = {}
    for name, schema in schemas.items():
        tagged = T.StructType([T.StructField("_table", T.StringType()), *schema.fields])
        mine = lines.where(F.col("value").startswith(f"{name},"))
        row = F.from_csv("value", tagged.simpleString()[len("struct<"):-1].replace(":", " "), {"mode": "FAILFAST"})
        out[name] = mine.select(row.alias("r")).select(*[F.col(f"r.`{f.name}`") for f in schema.fields])
    return out


def _as_line(df: DataFrame, name: str) -> DataFrame:
    return df.select(
        F.concat(F.lit(name + ","), F.to_csv(F.struct(*df.columns))).alias("value")
    )


def write_csvrel(path: str, mode: str = "errorifexists", **tables: DataFrame) -> None:
    """Several tables in one text output, each line prefixed by its table's name."""
    lines = [_as_line(df, name) for name, df in tables.items()]
    out = lines[0]
    for more in lines[1:]:
        out = out.unionByName(more)
    out.write.mode(mode).text(path)


def write_csvtab(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header row in each part file."""
    df.write.mode(mode).option("header", True).csv(path)


def write_result(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append to or replace a typed table; an append with other columns is refused."""
    stored = _stored_schema(df.sparkSession, path) if mode == "append" else None
    if stored is not None:
        require_schema(df, stored, f"append to {path}")
    df.write.mode(mode).parquet(path)


def _stored_schema(spark: SparkSession, path: str) -> T.StructType | None:
    try:
        return spark.read.parquet(path).schema
    except AnalysisException:
        return None


def insert_rows(spark: SparkSession, path: str, schema: T.StructType, rows: Iterable[tuple]) -> DataFrame:
    """Append tuples to a declared table and return the table."""
    write_result(spark.createDataFrame(list(rows), schema), path, "append")
    return spark.read.schema(schema).parquet(path)


WRITERS = {
    "csvtab": write_csvtab,
    "csvrel": lambda df, path, mode: write_csvrel(path, mode, **{path.rstrip("/").rsplit("/", 1)[-1]: df}),
    "parquet": write_result,
}


def fan_out(df: DataFrame, bindings: Sequence[tuple[str, str, str, bool]]) -> list[str]:
    """Write one table to several places: (format, path, mode, enabled).

    The table is computed once: for several enabled bindings it is written once to the shared folder, and
    the outputs are made from that copy, which no executor has to hold.  Returns their paths.
    """
    active = [b for b in bindings if b[3]]
    shared = cut_lineage(df) if len(active) > 1 else df
    for fmt, path, mode, _ in active:
        WRITERS[fmt](shared, path, mode)
    return [b[1] for b in active]


def schema_from_json(text: str) -> tuple[str, T.StructType]:
    """Table name and columns of a JSON table description."""
    spec = json.loads(text)

    def kind(column) -> T.DataType:
        if not column["arithmetic"]:
            return T.StringType()
        return T.DoubleType() if column["type"] in FLOAT_KINDS else T.LongType()

    return spec["name"], T.StructType([T.StructField(c["name"], kind(c)) for c in spec["columns"]])


# Type names used in exported table descriptions.
_EXPORT_NAMES = {
    T.BooleanType(): "bool",
    T.ByteType(): "signed char",
    T.ShortType(): "short",
    T.IntegerType(): "int",
    T.LongType(): "long",
    T.FloatType(): "float",
    T.DoubleType(): "double",
}


def schema_to_json(name: str, schema: T.StructType) -> str:
    columns = [
        {
            "name": f.name,
            "type": _EXPORT_NAMES.get(f.dataType, "string"),
            "arithmetic": f.dataType in _EXPORT_NAMES,
        }
        for f in schema
    ]
    return json.dumps({"name": name, "columns": columns})


