"""Readers of two public network log formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.operators.segments import Segments, positions
from tallyflow.shipping import ship
from tallyflow.sources.weblog import WebLogSource

# The fields of one WiFi access log line, in file order.
WIFI_FIELDS = (
    "site day moment parent aid state shortRet longRet strength quality mac classId "
    "srcPkts srcOct srcErrPkts srcErrOct dstPkts dstOct dstErrPkts dstErrOct dstMaxRetryErr ip"
).split()
WIFI_FIRST_AP = 29
WIFI_BASE_DAY = (2, 7, 20)


def _web_log(reader, path: str, **options):
    ship(SparkSession.getActiveSession())
    SparkSession.getActiveSession().dataSource.register(WebLogSource)
    return reader.format(WebLogSource.name()).options(**options).load(path)


def read_web_log(
    spark: SparkSession, path: str, sid_field: str = "type", hid_field: str = "server", key_field: str = "client"
) -> DataFrame:
    """Binary web log (a file or a folder) as an update stream; ``seq`` is the record's place in the file set.

    One scan: splits and numbers are planned from the files' lengths (see ``sources.weblog``).
    The store must be one that ``pyarrow.fs`` knows.
    """
    return _web_log(spark.read, path, sid_field=sid_field, hid_field=hid_field, key_field=key_field)


def stream_web_log(spark: SparkSession, path: str, max_records: int | None = None, **fields: str) -> DataFrame:
    """The same as a streaming DataFrame, with at most ``max_records`` in a micro-batch."""
    bound = {"max_records": str(max_records)} if max_records else {}
    return _web_log(spark.readStream, path, **bound, **fields)


def wifi_clock(day: Column, moment: Column, base: tuple[int, int, int] = WIFI_BASE_DAY) -> Column:
    """Seconds in a calendar of 31-day months and 365-day years, from the base day."""
    d, m = F.split(day, "-"), F.split(moment, ":")

    def days(y, mo, da):
        return 365 * y + 31 * mo + da - 31

    part = lambda a, i: a.getItem(i).cast("bigint")
    today = days(part(d, 0), part(d, 1), part(d, 2))
    return 86400 * (today - F.lit(days(*base))) + 3600 * part(m, 0) + 60 * part(m, 1) + part(m, 2)


def wifi_epoch(day: Column, moment: Column) -> Column:
    """Unix seconds of a two-digit-year day and a time."""
    text = F.concat_ws(" ", F.concat(F.lit("20"), F.lpad(F.split(day, "-").getItem(0), 2, "0"), F.lit("-"),
                                     F.lpad(F.split(day, "-").getItem(1), 2, "0"), F.lit("-"),
                                     F.lpad(F.split(day, "-").getItem(2), 2, "0")), moment)
    return F.unix_timestamp(F.to_timestamp(text, "yyyy-MM-dd H:m:s"))


def wifi_fields(lines: DataFrame) -> DataFrame:
    """Split text lines ``value``; a line without 22 fields raises."""
    parts = F.split(F.trim("value"), "\\s+")
    bad = F.raise_error(F.concat(F.lit("malformed log line: "), F.col("value"))).cast("array<string>")
    checked = lines.withColumn("_p", F.when(F.size(parts) == len(WIFI_FIELDS), parts).otherwise(bad))
    keep = [c for c in lines.columns if c != "value"]
    return checked.select(*keep, *[F.col("_p").getItem(i).alias(n) for i, n in enumerate(WIFI_FIELDS)])


def read_wifi_log(
    spark: SparkSession, path: str, layout: str = "access_point", sites: int | None = None, streams: int | None = None
) -> DataFrame:
    """WiFi text log as an update stream.

    ``access_point``: sid by building (names starting with L are 0), hid = access
    point, key = shortRet, time from the 31-day-month clock.  ``parent``: hid =
    dense code of the parent name, sid = aid % 2, key = longRet, Unix time.
    ``sites``/``streams`` reduce hid and sid modulo.  ``seq`` numbers the lines,
    which carry no number of their own: it is unique, ascends within each split of a
    file, and is the same whenever the same files are read.
    """
    numbered = spark.read.text(path).withColumn("seq", F.monotonically_increasing_id())
    lines = numbered.where(F.trim("value") != "")
    return wifi_updates(lines, layout, sites, streams)


def wifi_updates(
    lines: DataFrame, layout: str = "access_point", sites: int | None = None, streams: int | None = None
) -> DataFrame:
    """Parsed lines ``value, seq`` as updates."""
    f = wifi_fields(lines)
    if layout == "access_point":
        sid = F.when(F.col("site").startswith("L"), 0).otherwise(1)
        hid = F.col("aid").cast("int") - WIFI_FIRST_AP
        key, ts = F.col("shortRet"), wifi_clock(F.col("day"), F.col("moment"))
    elif layout == "parent":
        f = f.join(parent_codes(f), "parent")
        sid, hid, key = F.col("aid").cast("int") % 2, F.col("code"), F.col("longRet")
        ts = wifi_epoch(F.col("day"), F.col("moment"))
    else:
        raise ValueError(f"unknown layout {layout!r}")
    sid = sid if streams is None else F.pmod(sid, F.lit(streams))
    hid = hid if sites is None else F.pmod(hid, F.lit(sites))
    return f.select(
        sid.cast("int").alias("sid"),
        hid.cast("int").alias("hid"),
        key.cast("bigint").alias("key"),
        F.lit(1).cast("bigint").alias("upd"),
        ts.cast("bigint").alias("ts"),
        "seq",
    )


def parent_codes(fields: DataFrame) -> DataFrame:
    """Dense 0-based code of each parent, in the order of names."""
    names = fields.select("parent").distinct()
    ranked = positions(names, "code", segments=Segments.fit(names, ["parent"]))
    return ranked.select(F.col("code").cast("int").alias("code"), "parent")
