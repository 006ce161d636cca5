"""Message traffic tables: filters, tallies, set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the endpoint code: the low bit marks a response, the low byte
# the method, the rest the interface.
RESPONSE_MASK = 1
METHOD_MASK = 0xFE
ENDPOINT_MASK = 0xFF
INTERFACE_MASK = ~0xFF

BYTES_PER_MESSAGE = 20


def by_source(traffic: DataFrame, *hosts: int) -> DataFrame:
    return traffic.where(F.col("src").isin(*hosts))


def by_destination(traffic: DataFrame, *hosts: int) -> DataFrame:
    return traffic.where(F.col("dst").isin(*hosts))


def unicast(traffic: DataFrame, groups: Sequence[int]) -> DataFrame:
    """Channels to a single host; ``groups`` are the group addresses."""
    return traffic.where(~F.col("dst").isin(*groups))


def multicast(traffic: DataFrame, groups: Sequence[int]) -> DataFrame:
    return traffic.where(F.col("dst").isin(*groups))


def endpoint_is(code: int, mask: int) -> Column:
    m = F.lit(mask).cast("bigint")
    return F.col("endp").bitwiseAND(m) == F.lit(code & mask).cast("bigint")


def by_endpoint(traffic: DataFrame, code: int, mask: int) -> DataFrame:
    return traffic.where(endpoint_is(code, mask))


def by_interface(traffic: DataFrame, code: int) -> DataFrame:
    return by_endpoint(traffic, code, INTERFACE_MASK)


def by_method(traffic: DataFrame, code: int) -> DataFrame:
    """Requests and responses of one method."""
    return by_endpoint(traffic, code, INTERFACE_MASK | METHOD_MASK)


def requests(traffic: DataFrame) -> DataFrame:
    return by_endpoint(traffic, 0, RESPONSE_MASK)


def responses(traffic: DataFrame) -> DataFrame:
    return by_endpoint(traffic, 1, RESPONSE_MASK)


def tally(traffic: DataFrame, by: Sequence[str] = (), **exprs: Column) -> DataFrame:
    """Totals of messages and bytes, and of any further expressions."""
    return traffic.groupBy(*by).agg(
        F.sum("msgs").alias("msgs"),
        F.sum("bytes").alias("bytes"),
        *[F.sum(e).alias(n) for n, e in exprs.items()],
    )


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Channels of ``a`` that are not in ``b``."""
    return a.subtract(b)


def by_method_totals(traffic: DataFrame, interfaces: DataFrame) -> DataFrame:
    """Messages, bytes and cost per network and method; a method's response has the next endpoint.

    The traffic is summed per endpoint before it meets the interface rows.
    """
    replies = interfaces.where(~F.col("oneway")).withColumn("rpcc", F.col("rpcc") + 1)
    endpoints = interfaces.unionByName(replies).select("netname", F.col("rpcc").alias("endp"), "method")
    sums = traffic.groupBy("netname", "endp").agg(F.sum("msgs").alias("msgs"), F.sum("bytes").alias("bytes"))
    out = sums.join(endpoints, ["netname", "endp"]).groupBy("netname", "method")
    out = out.agg(F.sum("msgs").alias("msgs"), F.sum("bytes").alias("bytes"))
    return out.withColumn("total", F.col("msgs") * BYTES_PER_MESSAGE + F.col("bytes"))
