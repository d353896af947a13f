"""Model size, work per token and hardware peak as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Approximate dense bf16 peaks in TFLOP/s, by device name, in
# lookup order (the first match counts).
GPU_PEAKS = {"4060 Ti": 44.0, "T4": 65.0, "P100": 19.0, "L4": 121.0, "A100": 312.0, "H100": 989.0}
TPU_PEAKS = {"TPU v3": 61.5, "TPU v4": 275.0, "TPU v5 lite": 197.0, "TPU v5e": 197.0, "TPU v5p": 459.0,
             "TPU v6": 918.0}

CONFIG_COLUMNS = ("vocab", "d_model", "n_layers", "n_heads", "n_kv_heads", "head_dim", "ffn_dim")


def _long(name: str) -> Column:
    return F.col(name).cast("long")


def parameter_count(tied: bool = True) -> Column:
    """Parameters of a grouped-query transformer from its configuration columns."""
    d, width = _long("d_model"), _long("head_dim")
    attention = 2 * d * width * (_long("n_heads") + _long("n_kv_heads")) + 2 * width
    layer = attention + 3 * d * _long("ffn_dim") + 2 * d
    tables = 1 if tied else 2
    return _long("vocab") * d * tables + _long("n_layers") * layer + d


def flops_per_token(seq_len: int, tied: bool = True) -> Column:
    """Training work per token: six per parameter plus attention."""
    return 6 * parameter_count(tied) + 12 * _long("n_layers") * _long("n_heads") * _long("head_dim") * seq_len


def _first_match(peaks: dict[str, float], hit) -> Column:
    return F.coalesce(*[F.when(hit(key), F.lit(v)) for key, v in peaks.items()])


def gpu_peak(device: Column) -> Column:
    """Peak by substring of the device name, null if unknown."""
    return _first_match(GPU_PEAKS, lambda key: device.contains(key))


def tpu_peak(kind: Column) -> Column:
    """Peak by prefix of the device kind, null if unknown."""
    return _first_match(TPU_PEAKS, lambda key: kind.startswith(key))
