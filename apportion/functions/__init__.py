from apportion.functions.constants import constant
from apportion.functions.content import content_shard, event_content, vector_content
from apportion.functions.guards import (
    REPORT_BATCH,
    batch_latency_ms,
    or_zero,
    percent,
    ratio,
    throughput,
    whole,
)
from apportion.functions.pixels import chw_from_hwc, normalise
from apportion.functions.vectors import dot, predict

__all__ = [
    "REPORT_BATCH",
    "batch_latency_ms",
    "chw_from_hwc",
    "constant",
    "content_shard",
    "dot",
    "event_content",
    "normalise",
    "or_zero",
    "percent",
    "predict",
    "ratio",
    "throughput",
    "vector_content",
    "whole",
]
