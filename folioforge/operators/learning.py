"""Trained classifiers on TF-IDF features of words and word pairs (1 + ln(count), rows of length one): logistic regression, naive Bayes, calibrated linear SVM; random forest."""

from __future__ import annotations

import math
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LinearSVC, LinearSVCModel, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer, RegexTokenizer, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.operators.classification import folds
from folioforge.session import stored

#: At most so many terms, the most frequent ones, are features of a text.
VOCABULARY = 10_000

#: Tasks that the bounded rows of a training set are read in.
TRAIN_TASKS = 2


def _few_tasks(bounded: DataFrame) -> DataFrame:
    """At most TRAIN_ROWS rows in few tasks, as learning makes many passes."""
    return bounded.coalesce(TRAIN_TASKS)


#: Machines that learn at the same time.
MACHINES_AT_ONCE = 4


class Sublinear(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Counts of terms to 1 + ln(count), as vectors of the same terms."""

    def _transform(self, df: DataFrame) -> DataFrame:
        # no built-in function reaches the values of a sparse vector, and dense ones have VOCABULARY values a row
        @F.udf(VectorUDT())
        def damped(v):
            return SparseVector(v.size, v.indices, 1 + np.log(v.values))

        return df.withColumn("_log_counts", damped("_counts"))


def features(text: str, label: str, least: int = 2) -> list:
    """Stages from text to term weights of words and word pairs that stand in at least so many texts."""
    return [
        SQLTransformer(statement=f"SELECT *, coalesce({text}, '') AS _text FROM __THIS__"),
        StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="keep"),
        RegexTokenizer(inputCol="_text", outputCol="_w1", pattern=r"[^a-z0-9_]+", minTokenLength=2),
        NGram(n=2, inputCol="_w1", outputCol="_w2"),
        SQLTransformer(statement="SELECT *, concat(_w1, _w2) AS _terms FROM __THIS__"),
        CountVectorizer(inputCol="_terms", outputCol="_counts", vocabSize=VOCABULARY, minDF=least),
        Sublinear(),
        IDF(inputCol="_log_counts", outputCol="_weights"),
        Normalizer(inputCol="_weights", outputCol="features", p=2.0),
    ]


def sigmoid(margins: np.ndarray, positive: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Platt's slope and offset by Newton steps, halved where the loss grows.

    The targets are Platt's, (n+1)/(n+2) and 1/(m+2) for n positive and m negative rows, so separable
    margins have finite slopes too.
    """
    n, m = int(positive.sum()), int((~positive).sum())
    t = np.where(positive, (n + 1) / (n + 2), 1 / (m + 2))

    def loss(a: float, b: float) -> float:
        z = a * margins + b
        return float((np.maximum(z, 0) - t * z + np.log1p(np.exp(-np.abs(z)))).sum())

    a, b = 0.0, math.log((n + 1) / (m + 1))
    least = loss(a, b)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -500, 500)))
        d, w = p - t, p * (1 - p)
        ga, gb, haa, hab, hbb = (d * margins).sum(), d.sum(), (w * margins * margins).sum() + 1e-12, (w * margins).sum(), w.sum() + 1e-12
        det = haa * hbb - hab * hab
        da, db, step = -(hbb * ga - hab * gb) / det, -(haa * gb - hab * ga) / det, 1.0
        while step > 1e-10 and not loss(a + step * da, b + step * db) < least:
            step /= 2
        if step <= 1e-10:
            break
        a, b = float(a + step * da), float(b + step * db)
        least = loss(a, b)
    return a, b


def sigmoids(margins: DataFrame) -> dict[tuple[int, int], tuple[float, float]]:
    """The sigmoid of each part and class of (part, class, margin, positive), each found in one task."""

    def fit(key: tuple, rows: pa.Table) -> pa.Table:
        a, b = sigmoid(rows["margin"].to_numpy(), rows["positive"].to_numpy())
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "class": pa.array([key[1].as_py()], pa.int32()), "a": [a], "b": [b]})

    found = margins.groupBy("part", "class").applyInArrow(fit, "part int, class int, a double, b double").collect()
    return {(r["part"], r["class"]): (r["a"], r["b"]) for r in found}


class CalibratedSVM(Estimator):
    """One linear SVM for each class against the rest, calibrated on the margins of held-out rows.

    As many times as there are parts, stratified by label, the machines learn from the others and their
    margins on the part give a sigmoid for each class; a row's probabilities are the mean over the parts.
    The parts are dealt by the digest of the text: the column _key, else _text.
    """

    def __init__(self, parts: int = 3, **svm):
        super().__init__()
        self.parts, self.svm = parts, svm

    def _fit(self, df: DataFrame) -> CalibratedSVMModel:
        key = F.col("_key") if "_key" in df.columns else F.md5("_text")
        # without the label's metadata, whose class for unknown labels has no rows
        rows = df.select(F.col("label").alias("label", metadata={}), "features", key.alias("_key"))
        rows = stored(folds(rows, "label", "_key", self.parts).select("label", "features", "fold"), "parts")
        classes = int(rows.agg(F.max("label")).first()[0]) + 1
        rows = _few_tasks(rows).persist()

        def fit(at: tuple[int, int]) -> LinearSVCModel:
            learn = rows.filter(F.col("fold") != at[0]).withColumn("label", (F.col("label") == at[1]).cast("double"))
            return LinearSVC(rawPredictionCol="_raw", predictionCol="_one", **self.svm).fit(learn)

        with ThreadPool(MACHINES_AT_ONCE) as pool:
            found = pool.map(fit, [(i, c) for i in range(self.parts) for c in range(classes)])
        machines = [found[i * classes : (i + 1) * classes] for i in range(self.parts)]
        margins = None
        for i in range(self.parts):
            out = _margins(rows.filter(F.col("fold") == i), machines[i]).select(F.lit(i).alias("part"), "label", F.posexplode("_margins").alias("class", "margin"))
            margins = out if margins is None else margins.unionByName(out)
        curves = sigmoids(margins.select("part", "class", "margin", (F.col("label") == F.col("class")).alias("positive")))
        rows.unpersist()
        return CalibratedSVMModel(machines, curves)


def _margins(df: DataFrame, machines: list) -> DataFrame:
    """df with _margins, one for each machine."""
    for c, m in enumerate(machines):
        df = m.transform(df).withColumn(f"_m{c}", vector_to_array("_raw")[1]).drop("_raw", "_one")
    names = [f"_m{c}" for c in range(len(machines))]
    return df.withColumn("_margins", F.array(*names)).drop(*names)


class CalibratedSVMModel(Model, MLWritable, MLReadable):
    """The machines of each part and class, and their sigmoids."""

    def __init__(self, machines: list, curves: dict[tuple, tuple[float, float]]):
        super().__init__()
        self.machines, self.curves = machines, curves

    def _transform(self, df: DataFrame) -> DataFrame:
        total = F.array(*[F.lit(0.0)] * len(self.machines[0]))
        for i, machines in enumerate(self.machines):
            df = _margins(df, machines)
            p = [1 / (1 + F.exp(-(self.curves[i, c][0] * F.get("_margins", F.lit(c)) + self.curves[i, c][1]))) for c in range(len(machines))]
            df = df.withColumn(f"_p{i}", F.array(*p)).drop("_margins")
            whole = F.aggregate(f"_p{i}", F.lit(0.0), lambda x, y: x + y)
            even = F.lit(1 / len(machines))
            total = F.zip_with(total, F.transform(f"_p{i}", lambda x: F.coalesce(F.try_divide(x, whole), even)), lambda x, y: x + y)
        n = len(self.machines)
        df = df.withColumn("_mean", F.transform(total, lambda x: x / n)).drop(*(f"_p{i}" for i in range(n)))
        df = df.withColumn("prediction", (F.array_position("_mean", F.array_max("_mean")) - 1).cast("double"))
        return df.withColumn("probability", array_to_vector("_mean")).drop("_mean")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: CalibratedSVMModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m = self.model
        curves = [[*k, *v] for k, v in m.curves.items()]
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata={"curves": curves, "parts": len(m.machines), "classes": len(m.machines[0])})
        for i, machines in enumerate(m.machines):
            for c, machine in enumerate(machines):
                machine.save(f"{path}/machines/{i}-{c}")


class _Reader(MLReader):
    def load(self, path: str) -> CalibratedSVMModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        machines = [[LinearSVCModel.load(f"{path}/machines/{i}-{c}") for c in range(meta["classes"])] for i in range(meta["parts"])]
        m = CalibratedSVMModel(machines, {(i, c): (a, b) for i, c, a, b in meta["curves"]})
        m._resetUid(meta["uid"])
        return m


def models() -> dict:
    return {
        "logistic_regression": LogisticRegression(maxIter=40, regParam=0.01),
        "naive_bayes": NaiveBayes(smoothing=0.1),
        "linear_svm": CalibratedSVM(maxIter=20, regParam=0.01),
    }


#: At most so many labelled rows train a model; the rows of the smallest key digests are taken.
TRAIN_ROWS = 20_000


def train_all(df: DataFrame, text: str, label: str) -> dict[str, tuple[PipelineModel, PipelineModel]]:
    """Every model, with the feature stages that all share; features are computed once and kept in the shared folder."""
    prepared = Pipeline(stages=features(text, label)).fit(df)
    ready = prepared.transform(df).select("label", "features", F.md5(F.col(text)).alias("_key")).orderBy("_key").limit(TRAIN_ROWS)
    # a bounded sample, so a few tasks hold it; the features before it are computed in as many as the corpus has
    ready = _few_tasks(stored(ready, "features"))
    return {name: (m.fit(ready), prepared) for name, m in models().items()}


def train(df: DataFrame, text: str, label: str, name: str) -> PipelineModel:
    return Pipeline(stages=[*features(text, label), models()[name]]).fit(df)


def evaluate(model: PipelineModel, df: DataFrame) -> DataFrame:
    """(label, predicted, n) of held-out rows."""
    return model.transform(df).groupBy(F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("predicted")).agg(F.count("*").alias("n"))


def cross_validated(dealt: DataFrame, text: str, label: str) -> DataFrame:
    """(label, predicted, n, model): every row of dealt, which has its fold, scored once by models that learnt from the other folds."""
    out = None
    for k in sorted(r.fold for r in dealt.select("fold").distinct().collect()):
        trained = train_all(dealt.filter(F.col("fold") != k), text, label)
        held = None
        for name, (model, prepared) in trained.items():
            if held is None:
                held = stored(prepared.transform(dealt.filter(F.col("fold") == k)).select("label", "features"), "held")
            scored = stored(evaluate(model, held).withColumn("model", F.lit(name)), "scored")
            out = scored if out is None else out.unionByName(scored)
    return out.groupBy("label", "predicted", "model").agg(F.sum("n").alias("n")).select("label", "predicted", "n", "model")


def probabilities(model: PipelineModel, df: DataFrame, key: str) -> DataFrame:
    """(key, predicted, confidence, probabilities rounded to four places)."""
    p = model.transform(df).withColumn("_p", vector_to_array("probability"))
    return p.select(key, F.col("prediction").cast("int").alias("predicted"), F.bround(F.array_max("_p"), 4).alias("confidence"), F.transform("_p", lambda x: F.bround(x, 4)).alias("probabilities"))


def forest(df: DataFrame, inputs: list[str], label: str, trees: int = 50, seed: int = 42) -> tuple[PipelineModel, list[tuple[str, float]]]:
    """A random forest on numbers, and its feature importances, greatest first."""
    m = Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="features"), RandomForestClassifier(labelCol=label, numTrees=trees, seed=seed)]).fit(df)
    return m, sorted(zip(inputs, m.stages[-1].featureImportances.toArray().tolist()), key=lambda x: -x[1])


def flowers() -> list[tuple[float, float, float, float, int]]:
    """A stand-in for the public table of iris flowers: 50 of each class, drawn around the classes' published means with a fixed seed."""
    # Means and deviations of sepal length and width, petal length and width of each class.
    means = [(5.006, 3.428, 1.462, 0.246), (5.936, 2.770, 4.260, 1.326), (6.588, 2.974, 5.552, 2.026)]
    spread = [(0.352, 0.379, 0.174, 0.105), (0.516, 0.314, 0.470, 0.198), (0.636, 0.322, 0.552, 0.275)]
    rng = np.random.default_rng(42)
    return [(*np.round(rng.normal(m, s), 1).tolist(), k) for k, (m, s) in enumerate(zip(means, spread)) for _ in range(50)]


FLOWERS = "sepal_length double, sepal_width double, petal_length double, petal_width double, target int"
FLOWER_NAMES = {0: "setosa", 1: "versicolor", 2: "virginica"}
