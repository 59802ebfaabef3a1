"""Supervised models: Spark's own estimators behind one interface, and small networks in NumPy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linalg import moments

MODELS = ("rf", "svm", "xgb", "elasticnet", "mlp")


def estimator(model: str, seed: int = 42, features: int = 0, classes: int = 2, options: dict | None = None):
    cols = {"featuresCol": "features", "labelCol": "target"}
    more = options or {}
    if model == "rf":
        return RandomForestClassifier(**{"numTrees": 100} | more, seed=seed, **cols)
    if model == "svm":  # linear: Spark has no radial kernel
        return OneVsRest(classifier=LinearSVC(**more, **cols), **cols)
    if model == "xgb":  # boosted trees, two classes
        trees = GBTClassifier(**{"maxIter": 30} | more, seed=seed, **cols)
        return trees if classes == 2 else OneVsRest(classifier=trees, **cols)
    if model == "elasticnet":
        return LogisticRegression(**{"elasticNetParam": 0.5, "regParam": 0.01} | more, **cols)
    if model == "mlp":
        return MultilayerPerceptronClassifier(**{"layers": [features, 64, 32, classes]} | more, seed=seed, **cols)
    raise ValueError(f"model must be one of {MODELS}")


class Classifier:
    """Standardised features and one of ``MODELS``; fit, predict, cross-validated scores, importances."""

    def __init__(self, model: str = "rf", seed: int = 42, **options) -> None:
        """``options`` are parameters of Spark's estimator, such as ``numTrees`` or ``regParam``."""
        if model not in MODELS:
            raise ValueError(f"model must be one of {MODELS}")
        self.model, self.seed, self.options, self.fitted = model, seed, options, None

    @staticmethod
    def _rows(matrix: DataFrame) -> DataFrame:
        return matrix.select("sample_id", F.col("grp").cast("string").alias("label"), array_to_vector("values").alias("raw"))

    def fit(self, matrix: DataFrame) -> "Classifier":
        rows = self._rows(matrix)
        first = matrix.select(F.size("values").alias("p")).first()
        classes = rows.select("label").distinct().count()
        stages = [StringIndexer(inputCol="label", outputCol="target", stringOrderType="alphabetAsc", handleInvalid="keep"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), estimator(self.model, self.seed, first["p"], classes, self.options)]
        stages[0].setHandleInvalid("error")
        self.fitted = Pipeline(stages=stages).fit(rows)
        return self

    def predict(self, matrix: DataFrame) -> DataFrame:
        """sample_id, label, predicted."""
        names = self.fitted.stages[0].labels
        out = self.fitted.transform(self._rows(matrix))
        return out.select("sample_id", "label", F.get(F.array(*map(F.lit, names)), F.col("prediction").cast("int")).alias("predicted"))

    def predict_proba(self, matrix: DataFrame) -> DataFrame:
        """sample_id, label and one column for each class: the model's probabilities, or its scores through a soft maximum."""
        from pyspark.ml.functions import vector_to_array

        names = self.fitted.stages[0].labels
        out = self.fitted.transform(self._rows(matrix))
        if "probability" in out.columns:
            shares = vector_to_array("probability")
        else:
            raw = F.transform(vector_to_array("rawPrediction"), lambda x: F.exp(F.greatest(F.least(x, F.lit(30.0)), F.lit(-30.0))))
            shares = F.transform(raw, lambda x: x / F.aggregate(raw, F.lit(0.0), lambda a, b: a + b))
        return out.withColumn("_p", shares).select("sample_id", "label", *[F.get("_p", F.lit(i)).alias(n) for i, n in enumerate(names)])

    def _again(self, **changed) -> "Classifier":
        return Classifier(self.model, self.seed, **(self.options | changed))

    def out_of_fold(self, matrix: DataFrame, k: int = 3, strategy: str = "stratified_kfold", **how) -> DataFrame:
        """sample_id, label, fold, predicted and a column for each class: every sample judged by a model that has not seen it."""
        from .validation import folds

        labelled = {"label": "grp"} if strategy in ("stratified_kfold", "repeated_kfold") else {}
        dealt = folds(matrix, "sample_id", strategy, k, seed=self.seed, **labelled, **how)
        places = sorted((r["repeat"], r["fold"]) for r in dealt.select("repeat", "fold").distinct().collect())
        out = None
        for repeat, f in places:
            of = lambda role: matrix.join(dealt.where((F.col("repeat") == repeat) & (F.col("fold") == f) & (F.col("role") == role)).select("sample_id"), "sample_id", "left_semi")  # noqa: B023, E731
            model = self._again().fit(of("train"))
            test = of("test")
            one = model.predict_proba(test).join(model.predict(test).select("sample_id", "predicted"), "sample_id").withColumn("fold", F.lit(f)).withColumn("repeat", F.lit(repeat))
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        return out

    def cross_validate(self, matrix: DataFrame, k: int = 3, strategy: str = "stratified_kfold", **how) -> DataFrame:
        """fold, accuracy, balanced_accuracy, macro_f1 of each fold."""
        from .validation import class_metrics

        judged = self.out_of_fold(matrix, k, strategy, **how).select("repeat", "fold", "label", "predicted").persist()
        out = None
        for r in sorted(judged.select("repeat", "fold").distinct().collect()):
            m = class_metrics(judged.where((F.col("repeat") == r["repeat"]) & (F.col("fold") == r["fold"])), "label", "predicted").withColumn("fold", F.lit(r["fold"])).withColumn("repeat", F.lit(r["repeat"]))
            out = m if out is None else out.unionByName(m)
        return out

    def compare_strategies(self, matrix: DataFrame, strategies: list[str], k: int = 3) -> DataFrame:
        """strategy, mean, std, min, max of the accuracy over the folds of each way of splitting."""
        from .validation import fold_summary

        out = None
        for s in strategies:
            one = fold_summary(self.cross_validate(matrix, k, s), "accuracy").withColumn("strategy", F.lit(s))
            out = one if out is None else out.unionByName(one)
        return out.select("strategy", "mean", "std", "min", "max")

    def learning_curve(self, matrix: DataFrame, shares: list[float], test: float = 0.2) -> DataFrame:
        """share, samples, train and test accuracy of models fitted on growing parts of the training samples."""
        from .validation import learning_sizes, stratified_split

        split = stratified_split(matrix, "sample_id", "grp", test, self.seed)
        train, held = (split.where(F.col("role") == r).drop("role") for r in ("train", "test"))
        parts = learning_sizes(train, "sample_id", "grp", shares, self.seed)
        acc = lambda m, d: m.predict(d).agg(F.avg((F.col("label") == F.col("predicted")).cast("double"))).first()[0]
        rows = []
        for s in shares:
            part = train.join(parts.where(F.col("share") == float(s)).select("sample_id"), "sample_id", "left_semi")
            model = self._again().fit(part)
            rows.append((float(s), part.count(), acc(model, part), acc(model, held)))
        return matrix.sparkSession.createDataFrame(rows, "share double, samples long, train double, test double")

    def nested_cv(self, matrix: DataFrame, grid: list[dict], outer: int = 3, inner: int = 2) -> DataFrame:
        """fold, options (JSON), inner and outer accuracy: the options that win the inner folds of the training samples are judged on the outer fold."""
        import json

        from .validation import folds

        dealt = folds(matrix, "sample_id", "stratified_kfold", outer, label="grp", seed=self.seed)
        rows = []
        for f in range(outer):
            of = lambda role: matrix.join(dealt.where((F.col("fold") == f) & (F.col("role") == role)).select("sample_id"), "sample_id", "left_semi")  # noqa: B023, E731
            scores = [self._again(**o).cross_validate(of("train"), inner).agg(F.avg("accuracy")).first()[0] for o in grid]
            best = int(np.argmax(scores))
            judged = self._again(**grid[best]).fit(of("train")).predict(of("test")).agg(F.avg((F.col("label") == F.col("predicted")).cast("double"))).first()[0]
            rows.append((f, json.dumps(grid[best], sort_keys=True), float(scores[best]), float(judged)))
        return matrix.sparkSession.createDataFrame(rows, "fold int, options string, inner_accuracy double, outer_accuracy double")

    def importance(self) -> np.ndarray:
        """Impurity of trees, or mean |coefficient|."""
        m = self.fitted.stages[-1]
        if hasattr(m, "featureImportances"):
            return m.featureImportances.toArray()
        if hasattr(m, "coefficientMatrix"):
            return np.abs(m.coefficientMatrix.toArray()).mean(axis=0)
        if hasattr(m, "models"):
            return np.mean([np.abs(x.coefficients.toArray()) if hasattr(x, "coefficients") else x.featureImportances.toArray() for x in m.models], axis=0)
        raise ValueError("no importances for this model; use permutation_importance")

    def permutation_importance(self, matrix: DataFrame, features: int, rounds: int = 3) -> pd.DataFrame:
        """j, drop: loss of accuracy when a feature's values are dealt out anew by the hash of the sample.

        Values of a feature are permuted by a join on hash ranks of the samples.
        """
        from pyspark.sql import Window

        acc = lambda m: self.predict(m).agg(F.avg((F.col("label") == F.col("predicted")).cast("double"))).first()[0]
        base, rows = acc(matrix), []
        for j in range(features):
            drops = []
            for r in range(rounds):
                a = matrix.withColumn("_r", F.row_number().over(Window.orderBy(F.xxhash64("sample_id", F.lit(r)), "sample_id")))
                b = matrix.select(F.get("values", F.lit(j)).alias("_v"), F.row_number().over(Window.orderBy(F.xxhash64("sample_id", F.lit(r + 1000)), "sample_id")).alias("_r"))
                mixed = a.join(b, "_r").withColumn("values", F.transform("values", lambda v, i: F.when(i == j, F.col("_v")).otherwise(v)))  # noqa: B023
                drops.append(base - acc(mixed.drop("_r", "_v")))
            rows.append((j, float(np.mean(drops))))
        return pd.DataFrame(rows, columns=["j", "drop"])


class Autoencoder:
    """Dense autoencoder trained by Adam on all rows.

    Each epoch brings the rows to the driver once, batch by batch, in the order of a new hash.
    """

    def __init__(self, hidden: tuple[int, ...] = (32,), latent: int = 8, epochs: int = 50, rate: float = 1e-3, seed: int = 42) -> None:
        self.hidden, self.latent, self.epochs, self.rate, self.seed = hidden, latent, epochs, rate, seed

    def fit(self, matrix: DataFrame) -> "Autoencoder":
        n, self.mean, c = moments(matrix)
        sd = np.sqrt(np.maximum(np.diag(c) / n, 0))
        self.sd = np.where(sd > 0, sd, 1.0)
        sizes = [len(sd), *self.hidden, self.latent, *self.hidden[::-1], len(sd)]
        rng = np.random.default_rng(self.seed)
        w = [rng.normal(size=(a, b)) * np.sqrt(2 / a) for a, b in zip(sizes[:-1], sizes[1:], strict=True)]
        b = [np.zeros(s) for s in sizes[1:]]
        par = w + b
        m1, m2, step = [np.zeros_like(p) for p in par], [np.zeros_like(p) for p in par], 0
        linear = {len(self.hidden), len(w) - 1}
        for epoch in range(self.epochs):
            for x in self._mini_batches(matrix, epoch):
                acts = [x]
                for i in range(len(w)):
                    z = acts[-1] @ w[i] + b[i]
                    acts.append(z if i in linear else np.maximum(z, 0))
                d = 2 * (acts[-1] - x) / acts[-1].size
                gw, gb = [None] * len(w), [None] * len(w)
                for i in range(len(w) - 1, -1, -1):
                    if i not in linear:
                        d = d * (acts[i + 1] > 0)
                    gw[i], gb[i] = acts[i].T @ d, d.sum(0)
                    d = d @ w[i].T
                step += 1
                for k, g in enumerate(gw + gb):
                    m1[k] = 0.9 * m1[k] + 0.1 * g
                    m2[k] = 0.999 * m2[k] + 0.001 * g * g
                    par[k] -= self.rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
        self.w, self.b, self.linear = w, b, linear
        return self

    def _mini_batches(self, matrix: DataFrame, epoch: int, size: int = 64):
        """All rows, scaled, in arrays of ``size`` rows (the last may be smaller)."""

        def pack(batches):
            for b in batches:
                for a in range(0, len(b), 1024):
                    yield pd.DataFrame({"rows": [np.vstack(b["values"].iloc[a : a + 1024].to_numpy()).astype(float).tobytes()]})

        dealt = matrix.orderBy(F.xxhash64("sample_id", F.lit(self.seed), F.lit(epoch)), "sample_id").select("values")
        left = np.zeros((0, len(self.mean)))
        for r in dealt.mapInPandas(pack, "rows binary").toLocalIterator():
            x = (np.frombuffer(bytes(r["rows"])).reshape(-1, len(self.mean)) - self.mean) / self.sd
            left = np.vstack([left, x])
            whole = len(left) // size * size
            yield from (left[a : a + size] for a in range(0, whole, size))
            left = left[whole:]
        if len(left):
            yield left

    def encode(self, matrix: DataFrame) -> DataFrame:
        """sample_id, grp, values: the latent numbers, and ``error``: mean squared error of the reconstruction."""
        w, b, linear, mean, sd, cut = self.w, self.b, self.linear, self.mean, self.sd, len(self.hidden)
        kinds = {c.name: c.dataType.simpleString() for c in matrix.schema}

        def run(batches):
            for t in batches:
                x = (np.vstack(t["values"].to_numpy()) - mean) / sd
                a, code = x, None
                for i in range(len(w)):
                    z = a @ w[i] + b[i]
                    a = z if i in linear else np.maximum(z, 0)
                    code = a if i == cut else code
                yield pd.DataFrame({"sample_id": t["sample_id"], "grp": t["grp"], "values": list(code), "error": ((a - x) ** 2).mean(1)})

        return matrix.select("sample_id", "grp", "values").mapInPandas(run, f"sample_id {kinds['sample_id']}, grp {kinds['grp']}, values array<double>, error double")
