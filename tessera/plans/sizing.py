"""Closed-form sizing: throughput, latency and cost of index layouts, as column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import ValidationError

Z99 = 2.3263478740408408
BLOCK = 256
MB, GIB = 1e6, float(1 << 30)


def row_bytes(quantization: str, dimensions: int, m: int = 8) -> int:
    """Bytes of one row's code."""
    padded = -(-dimensions // BLOCK) * BLOCK
    if quantization == "product" and dimensions % m:
        raise ValidationError("m must divide the dimensions")
    sizes = {"none": 4 * dimensions, "scalar": dimensions, "two_bit": padded // 4 + 8, "one_bit": padded // 8 + 8, "product": m}
    if quantization not in sizes:
        raise ValidationError(quantization)
    return sizes[quantization]


def distinct_groups(groups: Column, nprobe: Column) -> Column:
    """Expected distinct groups that uniform probes touch."""
    return F.round(groups * (1 - F.pow(1 - 1 / groups, nprobe)))


def grouped_coverage(clusters: Column, nprobe: Column, per_object: float = 3.0) -> Column:
    """Expected clusters read where objects hold some clusters each."""
    return F.round(clusters * (1 - F.pow(1 - per_object / clusters, nprobe)))


def predict(cases: DataFrame) -> DataFrame:
    """Adds qps, latencies, costs and the bottleneck.

    Needs clients, stages, bytes_per_query, gets_per_query, ttfb_p50, ttfb_p99,
    conn_mbps, node_mbps, nodes, cpu_ms, price_get, price_hour. A stage moves an
    equal part of the bytes over an equal part of the requests.
    """
    c = F.col
    capacity = c("node_mbps") * c("nodes")
    per_stage = F.least(c("conn_mbps") * c("gets_per_query") / c("stages"), capacity)
    transfer = c("bytes_per_query") / MB / per_stage * 1000.0
    p50 = c("cpu_ms") + c("stages") * c("ttfb_p50") + transfer
    p99 = c("cpu_ms") + c("stages") * c("ttfb_p99") + transfer
    out = cases.withColumn("p50_ms", p50).withColumn("p99_ms", p99)
    out = out.withColumn("qps_bandwidth", capacity / (c("bytes_per_query") / MB)).withColumn("qps_closed", c("clients") / (c("p50_ms") / 1000.0))
    out = out.withColumn("qps", F.least("qps_bandwidth", "qps_closed"))
    out = out.withColumn("mean_ms", c("clients") / c("qps") * 1000.0)
    out = out.withColumn("cost_per_query", c("gets_per_query") * c("price_get") + c("nodes") * c("price_hour") / (c("qps") * 3600.0))
    return out.withColumn("bottleneck", F.when(c("qps_bandwidth") <= c("qps_closed"), "bandwidth").otherwise("closed_loop"))


def ranked_hardware(cases: DataFrame, min_qps: float, max_p99_ms: float) -> DataFrame:
    """Predictions that meet the targets by cost, then those that don't with their reasons."""
    p = predict(cases)
    reason = F.when(F.col("qps") < min_qps, "throughput").when(F.col("p99_ms") > max_p99_ms, "latency")
    return p.withColumn("rejected", reason).orderBy(F.col("rejected").isNotNull(), "cost_per_query")


def lognormal(p50: float, p99: float) -> tuple[float, float]:
    """(mu, sigma) of the latencies with two percentiles."""
    if not (p50 > 0 and math.isfinite(p50) and p99 >= p50):
        raise ValidationError("percentiles must be positive and in order")
    return math.log(p50), (math.log(p99) - math.log(p50)) / Z99
