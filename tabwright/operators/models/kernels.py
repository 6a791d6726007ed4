"""Random Fourier features (Rahimi and Recht 2007): a finite map whose dot products approximate the rbf kernel."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Transformer
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from tabwright.operators.models.recipe import FEATURES, Task, scaled_names, sql_number
from tabwright.operators.stats import aggregate_once


def kernel_width(data: DataFrame, task: Task) -> float:
    """gamma = 1 / (features * variance of all feature values)."""
    cells = data.select(F.explode(vector_to_array(FEATURES)).alias("x"))
    v = aggregate_once(cells, {"v": F.var_pop("x")})["v"]
    return 1.0 / (len(task.features) * (v or 1.0))


def fourier_stages(data: DataFrame, task: Task, dimensions: int, output: str, gamma: float | None = None) -> list[Transformer]:
    """sqrt(2 / D) cos(W x + b) with W ~ N(0, 2 gamma) and b uniform, as projections of the scaled columns."""
    gamma = gamma or kernel_width(data, task)
    names = scaled_names(task)
    rng = np.random.default_rng(task.seed)
    w = rng.normal(scale=np.sqrt(2 * gamma), size=(dimensions, len(names)))
    b = rng.uniform(0, 2 * np.pi, size=dimensions)
    scale = sql_number(float(np.sqrt(2.0 / dimensions)))
    parts = []
    for d in range(dimensions):
        dot = " + ".join(f"{sql_number(w[d, i])} * `{n}`" for i, n in enumerate(names))
        parts.append(f"{scale} * cos({sql_number(b[d])} + {dot}) AS {output}_{d}")
    return [SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__"),
            VectorAssembler(inputCols=[f"{output}_{d}" for d in range(dimensions)], outputCol=output)]
