"""Declared schemas: update streams, metadata, sketches and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


_INT, _LONG, _DBL, _STR = T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType()

UPDATE_SCHEMA = _struct(sid=_INT, hid=_INT, key=_LONG, upd=_LONG, ts=_LONG, seq=_LONG)

METADATA_SCHEMA = _struct(
    name=_STR,
    size=_LONG,
    ts_min=_LONG,
    ts_max=_LONG,
    key_min=_LONG,
    key_max=_LONG,
    stream_ids=T.ArrayType(_INT),
    source_ids=T.ArrayType(_INT),
    window=_LONG,
    warmup=_LONG,
)

SKETCH_SCHEMA = _struct(sid=_INT, d=_INT, b=_INT, c=_LONG)

# Result tables.  ``timeseries`` takes further value columns after ``time``.
TIMESERIES_SCHEMA = _struct(time=_LONG)
LOCAL_STREAM_STATS_SCHEMA = _struct(sid=_INT, hid=_INT, stream_len=_LONG)
HOST_TRAFFIC_SCHEMA = _struct(
    run_id=_STR, netname=_STR, protocol=_STR, src=_INT, dst=_INT, endp=_LONG, msgs=_LONG, bytes=_LONG
)
INTERFACES_SCHEMA = _struct(
    run_id=_STR, netname=_STR, protocol=_STR, rpcc=_LONG, iface=_STR, method=_STR, oneway=T.BooleanType()
)
COMM_RESULTS_SCHEMA = _struct(
    run_id=_STR,
    netname=_STR,
    protocol=_STR,
    dset_name=_STR,
    dset_window=_LONG,
    dset_warmup=_LONG,
    dset_size=_LONG,
    dset_duration=_LONG,
    dset_streams=_INT,
    dset_hosts=_INT,
    dset_bytes=_LONG,
    total_msg=_LONG,
    total_bytes=_LONG,
    traffic_ratio=_DBL,
)
MONITOR_RESULTS_SCHEMA = _struct(
    run_id=_STR,
    protocol=_STR,
    max_error=_DBL,
    statevec_size=_LONG,
    sites=_INT,
    sid=_INT,
    rounds=_LONG,
    subrounds=_LONG,
    updates_shipped=_LONG,
    bytes_shipped=_LONG,
)

# Bytes of one raw update record on the wire (fixed value of the record format).
RECORD_BYTES = 16

ORDER_COLUMNS = ("ts", "kind", "seq")


def order_columns(df: DataFrame) -> list[str]:
    """The columns that define stream order in ``df``: ts, then kind (if any), then seq."""
    return [c for c in ORDER_COLUMNS if c in df.columns]


def same_fields(a: T.StructType, b: T.StructType) -> bool:
    """Equal names and types, in order; nullability is ignored."""
    return [(f.name, f.dataType) for f in a] == [(f.name, f.dataType) for f in b]


def require_schema(df: DataFrame, schema: T.StructType, what: str) -> DataFrame:
    """Reject ``df`` unless it has exactly the fields of ``schema``."""
    if not same_fields(df.schema, schema):
        raise ValueError(f"{what}: expected {schema.simpleString()}, got {df.schema.simpleString()}")
    return df
