"""Statistics and features: sums that Spark aggregates in one pass, models through pyspark.ml."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def linear_regression(df: DataFrame, y: str, x: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, slope, intercept, r2) of y on x."""
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def correlation(a: Column, b: Column) -> Column:
    """Pearson's over the rows where both are set; 0 where a side is constant, null without rows."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when(F.count(x) > 0, F.coalesce(r, F.lit(0.0)))


def standardize(df: DataFrame, value: str, keys: Sequence[str] = (), mean: float | None = None, sd: float | None = None) -> DataFrame:
    """df with zscore = (value - mean) / sample deviation, given or of its group; 0 where the deviation is 0."""
    if mean is not None and sd is not None:
        return df.withColumn("zscore", (F.col(value) - mean) / sd if sd else F.lit(0.0))
    return _with_stats(df, keys, F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s")).withColumn("zscore", F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s")).otherwise(0.0)).drop("_m", "_s")


def minmax(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """df with scaled = (value - min) / (max - min); 0 where all values are equal."""
    return _with_stats(df, keys, F.min(value).alias("_a"), F.max(value).alias("_b")).withColumn("scaled", F.when(F.col("_b") > F.col("_a"), (F.col(value) - F.col("_a")) / (F.col("_b") - F.col("_a"))).otherwise(0.0)).drop("_a", "_b")


def _with_stats(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Aggregates joined back: partial sums, instead of a window that gathers a group."""
    if keys:
        return df.join(df.groupBy(*keys).agg(*aggregates), list(keys))
    return df.join(F.broadcast(df.agg(*aggregates)))


def one_hot(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    return df.select("*", *[(F.col(column).eqNullSafe(F.lit(v))).cast("int").alias(f"{column}_{v}") for v in values])


def polynomial(df: DataFrame, column: str, degree: int) -> DataFrame:
    return df.select("*", *[F.pow(F.col(column), F.lit(float(d))).alias(f"{column}_{d}") for d in range(2, degree + 1)])


def _assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(df)


MODELS: dict[str, object] = {}


def train(name: str, kind: str, df: DataFrame, features: Sequence[str], label: str | None = None, **options):
    """Fit and register a model: linear_regression, logistic_regression, kmeans, decision_tree, random_forest, gradient_boosting, regression_tree, neural_network (layers=[...]), svm, naive_bayes, pca."""
    from pyspark.ml import classification as c
    from pyspark.ml import clustering, feature, regression

    kinds = {
        "linear_regression": regression.LinearRegression, "logistic_regression": c.LogisticRegression, "kmeans": clustering.KMeans,
        "decision_tree": c.DecisionTreeClassifier, "regression_tree": regression.DecisionTreeRegressor, "random_forest": c.RandomForestClassifier, "neural_network": c.MultilayerPerceptronClassifier, "gradient_boosting": regression.GBTRegressor, "svm": c.LinearSVC, "naive_bayes": c.NaiveBayes, "pca": feature.PCA,
    }
    if kind == "pca":
        options |= {"inputCol": "features", "outputCol": "components"}
    elif label:
        options["labelCol"] = label
    model = kinds[kind](**options).fit(_assembled(df, features))
    MODELS[name] = (model, list(features), kind, label)
    return model


def predict(name: str, df: DataFrame) -> DataFrame:
    """df with the registered model's prediction (or components)."""
    model, features, _, _ = MODELS[name]
    return model.transform(_assembled(df, features)).drop("features", "rawPrediction")


def evaluate(name: str, df: DataFrame) -> dict[str, float]:
    """rmse and r2 of a regression, accuracy of a classifier, over df."""
    _, _, kind, label = MODELS[name]
    got = predict(name, df)
    if kind in ("linear_regression", "gradient_boosting"):
        err = F.col("prediction") - F.col(label)
        r = got.agg(F.sqrt(F.avg(err * err)).alias("rmse"), (1 - F.sum(err * err) / (F.var_pop(label) * F.count(label))).alias("r2")).first()
        return r.asDict()
    return {"accuracy": got.agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0]}


def save(name: str, path: str) -> None:
    """The model's files, and what it needs to be used again, in a folder that all executors share."""
    model, features, kind, label = MODELS[name]
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    kinds = type(model).__module__ + "." + type(model).__name__
    spark.createDataFrame([(name, features, kind, label, kinds)], "name string, features array<string>, kind string, label string, class string").coalesce(1).write.mode("overwrite").json(f"{path}/about")


def load(path: str, name: str | None = None) -> str:
    """A saved model under its old name or another; returns the name."""
    from importlib import import_module

    about = SparkSession.getActiveSession().read.schema("name string, features array<string>, kind string, label string, class string").json(f"{path}/about").first()
    module, _, kind = about["class"].rpartition(".")
    model = getattr(import_module(module), kind).load(f"{path}/model")
    MODELS[name or about["name"]] = (model, list(about["features"]), about["kind"], about["label"])
    return name or about["name"]


def model_info(name: str) -> dict[str, object]:
    model, features, kind, label = MODELS[name]
    return {"name": name, "kind": kind, "features": features, "label": label, "parameters": {p.name: v for p, v in model.extractParamMap().items()}}


def score_stream(name: str, stream: DataFrame, at: str, size: str, keys: Sequence[str] = (), late: str = "1 minute") -> DataFrame:
    """Streaming inference: (window_start, keys, n, prediction): the mean prediction of every window, rows scored as they come."""
    scored = predict(name, stream.withWatermark(at, late) if stream.isStreaming else stream)
    got = scored.groupBy(F.window(at, size).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.avg("prediction").alias("prediction"))
    return got.select(F.col("w.start").alias("window_start"), *keys, "n", "prediction")


def drop_model(name: str) -> bool:
    return MODELS.pop(name, None) is not None


def list_models() -> list[tuple[str, str]]:
    return sorted((n, m[2]) for n, m in MODELS.items())
