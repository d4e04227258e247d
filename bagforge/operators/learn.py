"""Models over bags: forests and elastic nets of Spark ML, Gaussian processes in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vectors(fp: DataFrame, values: DataFrame, n_features: int) -> DataFrame:
    """(mol_id, features, label) from bags and values(mol_id, value); a feature id beyond n_features is an error."""
    from pyspark.ml.functions import array_to_vector

    check = F.assert_true(F.col("feat_id") < n_features, F.lit("a feature beyond the number of features"))
    ok = fp.where(check.isNull())
    bags = ok.groupBy("mol_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("feat_id").cast("int"), F.col("cnt").cast("double")))).alias("bag"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(n_features - 1)), lambda i: F.coalesce(F.element_at("bag", i), F.lit(0.0)))
    return bags.join(values, "mol_id").select("mol_id", array_to_vector(dense).alias("features"), F.col("value").cast("double").alias("label"))


def random_forest(train: DataFrame, trees: int = 50, seed: int = 1, classify: bool = False):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.regression import RandomForestRegressor

    return (RandomForestClassifier if classify else RandomForestRegressor)(numTrees=trees, seed=seed).fit(train)


def elastic_net(train: DataFrame, strength: float = 0.1, mix: float = 0.5):
    from pyspark.ml.regression import LinearRegression

    return LinearRegression(regParam=strength, elasticNetParam=mix).fit(train)


def save(model, path: str) -> None:
    """Writes a fitted model, over what is there."""
    model.write().overwrite().save(path)


def load(path: str):
    """A model that save wrote, of whichever of these kinds it is."""
    from pyspark.ml.util import DefaultParamsReader
    from pyspark.sql import SparkSession

    return DefaultParamsReader.loadParamsInstance(path, SparkSession.getActiveSession().sparkContext)


def cross_validated(rows: DataFrame, fit, k: int) -> DataFrame:
    """(mol_id, label, prediction) for rows with a fold column: each fold predicted by a model of the others."""
    out = None
    for f in range(k):
        model = fit(rows.where(F.col("fold") != f))
        part = model.transform(rows.where(F.col("fold") == f)).select("mol_id", "label", "prediction")
        out = part if out is None else out.unionByName(part)
    return out


def tanimoto_kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min/max similarity of dense count rows."""
    shared = np.array([np.minimum(x, b).sum(axis=1) for x in a])
    whole = a.sum(axis=1)[:, None] + b.sum(axis=1)[None] - shared
    return np.divide(shared, whole, out=np.zeros_like(shared, dtype=float), where=whole > 0)


def rbf_kernel(width: float):
    """Gaussian similarity of dense rows."""
    return lambda a, b: np.exp(-np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T, 0) / (2 * width * width))


def _fitted(kernel: str, x: np.ndarray, y: np.ndarray, noise: float):
    """(similarity, its scale, noise): given for 'tanimoto'; for 'flexible' and 'rbf' those of the greatest marginal likelihood over a grid."""
    if kernel == "tanimoto":
        return tanimoto_kernel, 1.0, noise
    widths = [tanimoto_kernel] if kernel == "flexible" else [rbf_kernel(w * (np.sqrt(x.var(axis=0).sum()) or 1.0)) for w in (0.25, 0.5, 1, 2, 4)]
    best = None
    for k in widths:
        values, vectors = np.linalg.eigh(k(x, x))  # one decomposition serves every scale and noise
        p = (vectors.T @ y) ** 2
        for scale in (0.1, 0.3, 1.0, 3.0, 10.0) if kernel == "flexible" else (1.0,):
            for white in (1e-3, 1e-2, 0.1, 0.3, 1.0):
                d = scale * np.maximum(values, 0) + white
                fit = -0.5 * ((p / d).sum() + np.log(d).sum())
                if best is None or fit > best[0]:
                    best = (fit, k, scale, white)
    return best[1:]


def gaussian_process(train_x: np.ndarray, train_y: np.ndarray, x: np.ndarray, noise: float = 0.1, kernel: str = "tanimoto") -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation at x; values are normalised first. kernel: 'tanimoto', 'flexible' (its scale and noise fitted) or 'rbf' (width and noise fitted). For training sets of a few thousand rows."""
    m, s = train_y.mean(), train_y.std() or 1.0
    y = (train_y - m) / s
    similar, scale, noise = _fitted(kernel, train_x, y, noise)
    low = np.linalg.cholesky(scale * similar(train_x, train_x) + noise * np.eye(len(train_x)))
    k = scale * similar(x, train_x)
    alpha = np.linalg.solve(low.T, np.linalg.solve(low, y))
    v = np.linalg.solve(low, k.T)
    return k @ alpha * s + m, np.sqrt(np.maximum(scale + noise - (v * v).sum(axis=0), 0)) * s


def gaussian_classifier(train_x: np.ndarray, train_y: np.ndarray, x: np.ndarray, kernel: str = "tanimoto") -> np.ndarray:
    """Probability of label 1 at x: Laplace's approximation of a logistic Gaussian process (labels 0 and 1)."""
    similar = tanimoto_kernel if kernel == "tanimoto" else rbf_kernel(np.sqrt(train_x.var(axis=0).sum()) or 1.0)
    k, t, f = similar(train_x, train_x), train_y.astype(float), np.zeros(len(train_y))
    for _ in range(50):
        p = 1 / (1 + np.exp(-f))
        w = p * (1 - p)
        root = np.sqrt(w)
        low = np.linalg.cholesky(np.eye(len(f)) + root[:, None] * k * root[None])
        b = w * f + t - p
        a = b - root * np.linalg.solve(low.T, np.linalg.solve(low, root * (k @ b)))
        new = k @ a
        if np.abs(new - f).max() < 1e-8:
            break
        f = new
    p = 1 / (1 + np.exp(-f))
    root = np.sqrt(p * (1 - p))
    low = np.linalg.cholesky(np.eye(len(f)) + root[:, None] * k * root[None])
    c = similar(x, train_x)
    mean, v = c @ (t - p), np.linalg.solve(low, root[:, None] * c.T)
    spread = np.maximum(1 - (v * v).sum(axis=0), 0)
    return 1 / (1 + np.exp(-mean / np.sqrt(1 + np.pi * spread / 8)))


def gaussian_process_folds(rows: DataFrame, train_rows: int, noise: float = 0.1, kernel: str = "tanimoto") -> DataFrame:
    """(mol_id, label, mean, sd) for rows(mol_id, counts array, label, fold): each fold is one task with its own training set.

    train_rows bounds a fold's training set by a hash of mol_id, as a Gaussian process is cubic in it: the rows that
    come first by the hash, somewhat more than are needed, are chosen before any are sent, so that a task gets its own
    fold's rows and a bounded number of others.
    """
    from .dictionary import numbered

    k = rows.agg(F.max("fold")).first()[0] + 1
    first = int(1.2 * train_rows * k / max(k - 1, 1)) + 100
    placed = numbered(rows.withColumn("h", F.xxhash64("mol_id")), ["h", "mol_id"], "at").drop("h")
    others = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col("fold"))
    train = placed.where(F.col("at") < first).withColumn("to", F.explode(others)).withColumn("test", F.lit(False))
    sent = placed.withColumn("to", F.col("fold").cast("int")).withColumn("test", F.lit(True)).unionByName(train)

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        train = g[~g["test"]].sort_values("at").head(train_rows)
        test = g[g["test"]]
        if not len(train) or not len(test):
            return pd.DataFrame({"mol_id": [], "label": [], "mean": [], "sd": []})
        mean, sd = gaussian_process(np.stack(train.counts), train.label.to_numpy(), np.stack(test.counts), noise, kernel)
        return pd.DataFrame({"mol_id": test.mol_id, "label": test.label, "mean": mean, "sd": sd})

    return sent.groupBy("to").applyInPandas(run, "mol_id long, label double, mean double, sd double")
