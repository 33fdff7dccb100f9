"""Orthogonal projection away from a matrix's strongest directions, and low-rank redistribution.

Row matrices are tables of vectors and stay distributed: their Gram matrix, of the
vectors' dimension squared, is summed up by partial aggregation, and its
eigenvectors are the matrix's singular vectors. Small matrices by id go through
``applyInPandas``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def gram(rows: DataFrame, vector: str = "embedding") -> np.ndarray:
    """The sum of outer products of all vectors; one matrix per task comes together."""

    def partial(batches):
        total = None
        for b in batches:
            column = b.column(0)
            if len(column):
                x = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(total)), len(total)), pa.int32()), pa.array(np.tile(np.arange(len(total)), len(total)), pa.int32()), pa.array(total.ravel())], ["i", "j", "x"])

    sums = rows.where(F.col(vector).isNotNull()).select(vector).mapInArrow(partial, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    n = int(sums["i"].max()) + 1 if len(sums) else 0
    out = np.zeros((n, n))
    out[sums["i"], sums["j"]] = sums["x"]
    return out


def top_directions(rows: DataFrame, k: int = 64, vector: str = "embedding") -> np.ndarray:
    """(dimension, k) leading right singular vectors; k is at most the dimension less one, and none if it isn't positive."""
    g = gram(rows, vector)
    k = min(k, len(g) - 1)
    if k <= 0:
        return np.zeros((len(g), 0))
    _, v = np.linalg.eigh(g)
    return v[:, ::-1][:, :k]


def _without(out: Column, vector: Column, axis: Column) -> Column:
    dot = F.aggregate(F.zip_with(vector, axis, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return F.zip_with(out, axis, lambda a, b: a - dot * b)


def projected(vector: Column, directions: np.ndarray) -> Column:
    """vector less its part in the span of a few orthonormal directions, in the JVM; each component is a literal of the plan."""
    out = vector.cast("array<double>")
    for u in directions.T:
        out = _without(out, vector.cast("array<double>"), F.array(*(F.lit(float(x)) for x in u)))
    return out


def without_directions(rows: DataFrame, directions: np.ndarray, vector: str = "embedding") -> DataFrame:
    """rows with their vectors less the parts in the span of any number of orthonormal directions, which travel to the workers as one matrix."""
    shared = rows.sparkSession.sparkContext.broadcast(directions)  # dimension x k
    kinds = ", ".join(f"`{f.name}` {'array<double>' if f.name == vector else f.dataType.simpleString()}" for f in rows.schema)

    def run(batches):
        u = shared.value
        for b in batches:
            at = b.schema.get_field_index(vector)
            column = b.column(at)
            held = np.flatnonzero(np.asarray(column.is_valid()))
            x = np.asarray(column.take(pa.array(held)).flatten(), np.float64).reshape(len(held), -1) if len(held) else np.zeros((0, len(u)))
            left = iter(x - (x @ u) @ u.T)
            out = pa.array([next(left) if ok else None for ok in column.is_valid().to_pylist()], pa.list_(pa.float64()))
            yield b.set_column(at, pa.field(vector, out.type), out)

    return rows.mapInArrow(run, kinds)


def top_left_singular(weight: np.ndarray, k: int) -> np.ndarray:
    """Leading left singular vectors of a matrix in memory; k at most its rows less one."""
    k = min(k, weight.shape[0] - 1)
    if k <= 0:
        return np.zeros((weight.shape[0], 0))
    return np.linalg.svd(weight, full_matrices=False)[0][:, :k]


def redistributed(a: np.ndarray, b: np.ndarray, u: np.ndarray, ridge: float = 1e-6) -> np.ndarray:
    """The B whose product with A is nearest to B A without its part in the span of u."""
    change = b @ a
    kept = change - u @ (u.T @ change)
    return np.linalg.solve(a @ a.T + ridge * np.eye(len(a)), a @ kept.T).T


def reproject_adapters(matrices: DataFrame, k: int = 64) -> DataFrame:
    """(name, b): for each row (name, weight, a, b) of nested arrays the redistributed b. One module's matrices fit in a task by nature."""

    def run(pdf):
        import pandas as pd

        def one(r):
            w, a, b = (np.array([list(x) for x in r[c]], float) for c in ("weight", "a", "b"))
            return redistributed(a, b, top_left_singular(w, k)).tolist()

        return pd.DataFrame({"name": pdf["name"], "b": [one(r) for r in pdf.to_dict("records")]})

    return matrices.groupBy("name").applyInPandas(run, "name string, b array<array<double>>")


def parameter_share(parameters: DataFrame) -> DataFrame:
    """One row: trainable, total and their ratio, from (name, size, trainable)."""
    own = F.sum(F.when(F.col("trainable"), F.col("size")).otherwise(0))
    return parameters.agg(own.alias("trainable"), F.sum("size").alias("total")).withColumn("share", F.col("trainable") / F.greatest("total", F.lit(1)))


def parameter_groups(parameters: DataFrame, lr_a: float = 1e-4, lr_b: float = 8e-4) -> DataFrame:
    """(name, group, learning_rate) of the trainable parameters, by the name's pattern."""
    group = F.when(F.contains("name", F.lit("lora_A")), "lora_A").when(F.contains("name", F.lit("lora_B")), "lora_B").otherwise("other")
    rows = parameters.where("trainable").withColumn("group", group)
    return rows.select("name", "group", F.when(F.col("group") == "lora_B", lr_b).otherwise(lr_a).alias("learning_rate"))
