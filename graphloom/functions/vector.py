"""Vector scores as column expressions: they stay inside the JVM and need no Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NAMES = {
    "l2": ("l2", "euclidean", "l2-distance"),
    "squared-l2": ("squared-l2", "squared-euclidean", "sq-l2", "squared_l2", "sqeuclidean", "sql2"),
    "dot": ("dot", "dot-product", "inner", "inner-product", "ip"),
}


def metric_name(name: str) -> str:
    """The metric that a name or alias stands for."""
    for metric, names in _NAMES.items():
        if name.lower() in names:
            return metric
    raise ValueError(f"unknown metric: {name}")


def _doubles(vector: Column | list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector]) if isinstance(vector, (list, tuple)) else vector.cast("array<double>")


def _fold(a, b, step) -> Column:
    """Sum of step(x, y); 0 where a side is missing or the dimensions differ."""
    a, b = _doubles(a), _doubles(b)
    total = F.aggregate(F.zip_with(a, b, step), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(a) == F.size(b), total).otherwise(F.lit(0.0))


def squared_l2(a, b) -> Column:
    return _fold(a, b, lambda x, y: (x - y) * (x - y))


def l2(a, b) -> Column:
    return F.sqrt(squared_l2(a, b))


def dot(a, b) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def score(metric: str, a, b) -> Column:
    """Higher is better: -l2, -squared l2, or the dot product."""
    metric = metric_name(metric)
    return dot(a, b) if metric == "dot" else -(l2(a, b) if metric == "l2" else squared_l2(a, b))
