"""Return and revenue models with guards against no signal.

Rows are split, encoded and cut into byte blocks once; `tallymark.learn` then fits the full
model and one model per fold in the same jobs.
"""

from __future__ import annotations

from collections import namedtuple
from functools import cached_property, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.learn import blocks as bl
from tallymark.learn import boosting, forest, linear
from tallymark.learn.moments import collect_moments
from tallymark.operators import scores
from tallymark.operators.ordered import positions
from tallymark.session import materialise, settings, shared_folder

# The features of both models.
CATEGORICAL = ["Region", "Product", "CustomerType", "PaymentMethod", "Promotion",
               "StoreLocation", "Salesperson", "DiscountBucket"]
RETURN_NUMBERS = ["Quantity", "UnitPrice", "Discount", "ShippingCost", "DeliveryDays"]
REVENUE_NUMBERS = ["Quantity", "UnitPrice", "Discount", "ShippingCost"]
NO_SIGNAL_AUC = 0.55
MISSING = "nan"
MAJORITY = "most frequent class"
SEED = 42
# The models and their parameters.
CLASSIFIERS = ["Logistic Regression", "Decision Tree", "Random Forest", "Gradient Boosting"]
REGRESSORS = ["Linear Regression", "Random Forest", "Gradient Boosting"]
TREE_DEPTH, BOOSTED_DEPTH, RATE = 6, 3, 0.1
# Rows that lie by order already are not shuffled once more for a join by label and order.
SUBSET_KEYS = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}

Scale = namedtuple("Scale", "mean std")


def stratified(df: DataFrame, label: str, key: str = "OrderID", parts: int = 5,
               folds: int = 5, number: Column | None = None) -> DataFrame:
    """Add `is_test`, true for one in `parts` keys of each label, and `fold` for the others.

    The keys of a label are put in the order of `number`, by default a hash of the key, and
    dealt out in turn, so every part has the same share of each label, on every run. The lines
    of a key with the same label stay together.
    """
    number = F.xxhash64(key) if number is None else number
    marked = df.withColumn("_number", number)
    place = positions(marked, "_number", [label], "_place")
    out = marked.join(place.withColumnsRenamed({label: "_label", "_number": "_key"}),
                      F.col(label).eqNullSafe(F.col("_label"))
                      & (F.col("_number") == F.col("_key")))
    turn = F.col("_place") % parts
    return (out.withColumn("is_test", turn == 0)
            .withColumn("fold", (F.floor(F.col("_place") / parts) % folds).cast("int"))
            .drop("_number", "_label", "_key", "_place"))


class Features:
    """Encoding fitted on the training rows: codes of the categories, and the numbers.

    The distinct training values of a category, however many, get their alphabetical place as
    code; null is the value `nan`, and a value unseen in training gets the code after the last.
    Codes are looked up by a join, which Spark broadcasts while the list is small. Codes and
    numbers are standardised by training mean and sample deviation. A null number is an error:
    rows are never dropped without notice.
    """

    def __init__(self, categorical: list[str], numbers: list[str]):
        self.categorical, self.numbers = categorical, numbers
        self.names = [*categorical, *numbers]

    def _prepare(self, df: DataFrame) -> DataFrame:
        text = {c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in self.categorical}
        return df.withColumns(text | {c: F.col(c).cast("double") for c in self.numbers})

    def fit(self, train: DataFrame) -> "Features":
        train = self._prepare(train)
        listed = F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(c).alias("level"))
            for c in self.categorical]))
        self.codes = materialise(positions(
            train.select(listed.alias("c")).select("c.*"), "level", ["column"], "code"), "codes")
        sizes = {r["column"]: r["n"] for r in self.codes.groupBy("column").agg(
            F.count(F.lit(1)).alias("n")).collect()}  # a row per category
        self.sizes = {c: sizes.get(c, 0) for c in self.categorical}
        self._train = train
        return self

    def coded(self, df: DataFrame) -> DataFrame:
        """`df` with a column `<category>_code` for each category."""
        out = self._prepare(df)
        for c in self.categorical:
            own = self.codes.where(F.col("column") == c).select(
                F.col("level").alias(f"_{c}"), F.col("code").cast("double").alias(f"{c}_code"))
            out = out.join(own, F.col(c) == F.col(f"_{c}"), "left").drop(f"_{c}")
        return out.withColumns({f"{c}_code": F.coalesce(f"{c}_code", F.lit(float(self.sizes[c])))
                                for c in self.categorical})

    @cached_property
    def inputs(self) -> list[str]:
        """Columns of `coded` that the models read, in the order of `names`."""
        return [f"{c}_code" for c in self.categorical] + self.numbers

    def scaler(self) -> Scale:
        """Training mean and sample deviation per column of `names`."""
        return self._scale

    @cached_property
    def _scale(self) -> Scale:
        return Scale(*collect_moments(self.coded(self._train), self.inputs).scale())


class Prepared:
    """Split, encoded and cut rows. Each part is made when it is first asked for, and written to
    the shared folder: a lost executor then costs a re-read, not the joins behind the sales."""

    def __init__(self, df: DataFrame, numbers: list[str], parts: int, folds: int,
                 number: Column | None, stratify: bool, scaled: bool = True):
        """`scaled` keeps the scaled values in the blocks, which only linear models read."""
        shared_folder(df.sparkSession)
        self.numbers, self.folds, self.scaled = numbers, folds, scaled
        # Approximate cut points follow the order of the rows; classes keep the one they have had.
        self.codec, self.keys = (None, {}) if stratify else ("zstd", SUBSET_KEYS)
        known = df.where(F.col("label").isNotNull()).withColumn("_one", F.lit(1))
        self._split = stratified(known, "label" if stratify else "_one", "OrderID", parts, folds, number)

    @cached_property
    def rows(self) -> DataFrame:
        with settings(self._split.sparkSession, self.keys):
            return materialise(self._split.select("OrderID", "label", "is_test", "fold", *CATEGORICAL,
                                                  *self.numbers), "model-rows", self.codec)

    @cached_property
    def features(self) -> Features:
        return Features(CATEGORICAL, self.numbers).fit(self.rows.where(~F.col("is_test")))

    @cached_property
    def sides(self) -> dict[tuple[bool, float], int]:
        """Rows by side and label; two labels if these are classes."""
        return {(r["is_test"], r["label"]): r["n"] for r in self.rows.groupBy("is_test", "label").agg(
            F.count(F.lit(1)).alias("n")).collect()}

    @cached_property
    def n_rows(self) -> tuple[int, int]:
        """Rows of the training and of the test side."""
        one = self.rows.agg(F.count_if(~F.col("is_test")).alias("train"),
                            F.count_if("is_test").alias("test")).first()
        return one["train"], one["test"]

    @cached_property
    def coded(self) -> DataFrame:
        part = F.when(F.col("is_test"), F.lit(bl.TEST)).otherwise(F.col("fold")).alias("part")
        return materialise(self.features.coded(self.rows).select(
            "OrderID", "label", part, *self.features.inputs), "coded-rows", self.codec)

    @cached_property
    def cuts(self) -> list[np.ndarray]:
        return bl.cut_points(self.coded.where(F.col("part") != bl.TEST), self.features.inputs)

    @cached_property
    def scale(self) -> Scale:
        train = self.coded.where(F.col("part") != bl.TEST)
        return Scale(*collect_moments(train, self.features.inputs).scale())

    @cached_property
    def blocks(self) -> DataFrame:
        return bl.make_blocks(self.coded, self.features.inputs, self.cuts, self.scale.mean,
                              self.scale.std, sum(self.n_rows), "OrderID", self.scaled)

    def sizes(self) -> DataFrame:
        """Rows per side, fold (of the training side) and label."""
        return self._split.groupBy("is_test", F.when(~F.col("is_test"), F.col("fold")).alias("fold"),
                                   "label").agg(F.count(F.lit(1)).alias("lines"))


class Fitted:
    """What the two families share: fitted models by name, scores, importances."""

    def _importances(self, name: str, top: int) -> DataFrame | None:
        model = self.models[name]
        if isinstance(model, np.ndarray):
            return None  # linear models have none
        rows = list(zip(self.data.features.names, [float(v) for v in model.importances()]))
        return (self.spark.createDataFrame(rows, "feature string, importance double")
                .orderBy(F.desc("importance"), "feature").limit(top))

    def _boosted(self, rounds: int, models: int, logistic: bool) -> tuple[boosting.Boosted, DataFrame]:
        fitted = boosting.fit_boosted(self.data.blocks, models, rounds, BOOSTED_DEPTH, RATE, logistic)

        def score(block: bl.Block, model: int) -> np.ndarray:
            raw = fitted.raw(block, model)
            return linear.probability(raw) if logistic else raw

        return fitted, bl.scored_rows(self.data.blocks, score, models, boosting.COLUMNS)

    def _forest(self, trees: int, models: int, tries: int, depth: int | None) -> tuple[forest.Forest, DataFrame]:
        fitted = forest.fit_forest(self.data.blocks, models, trees, tries, self.data.n_rows[0], SEED, depth)
        return fitted, forest.score_forest(self.data.blocks, fitted)


class ReturnModels(Fitted):
    """Fits the four classifiers, each with one model per fold, and keeps what the report needs."""

    def __init__(self, df: DataFrame, trees: int = 100, folds: int = 5, forest_depth: int | None = None,
                 names: list[str] | None = None, number: Column | None = None, cross: bool = True):
        """`forest_depth` None grows the forest until its leaves are pure. Without `cross` only the
        full models are fitted, and there is no `cv_auc`."""
        self.spark = df.sparkSession
        self.data = Prepared(df.withColumn("label", F.col("Returned").cast("double")),
                             RETURN_NUMBERS, 5, folds, number, stratify=True,
                             scaled=names is None or "Logistic Regression" in names)
        self.models: dict[str, object] = {}
        models = 1 + folds if cross else 1
        self.trees, self.depth = trees, forest_depth
        scored = {}
        for name in CLASSIFIERS:
            if names is None or name in names:
                self.models[name], scored[name] = self._fit(name, models)
        self.scored = reduce(DataFrame.unionByName, [
            s.withColumn("name", F.lit(name)).withColumn("prediction", (F.col("score") > 0.5).cast("double"))
            for name, s in scored.items()])
        self.predictions = {name: self.scored.where((F.col("name") == name) & (F.col("model") == 0)).select(
            "label", "prediction", "score") for name in scored}

    def _fit(self, name: str, models: int):
        blocks = self.data.blocks
        if name == "Logistic Regression":
            weights = linear.fit_logistic(blocks, models)
            return weights, bl.scored_rows(blocks, lambda b, m: linear.predict_logistic(weights, b, m),
                                           models, linear.COLUMNS)
        if name == "Decision Tree":
            tree = boosting.fit_boosted(blocks, models, 1, TREE_DEPTH, 1.0, start_at_mean=False)
            return tree, bl.scored_rows(blocks, lambda b, m: tree.raw(b, m), models, boosting.COLUMNS)
        if name == "Random Forest":
            return self._forest(self.trees, models, int(len(self.data.features.names) ** 0.5), self.depth)
        return self._boosted(self.trees, models, logistic=True)

    @cached_property
    def results(self) -> list[dict]:
        """Metrics of each model on the test side, and the mean AUC over the folds."""
        label, guess = F.col("label"), F.col("prediction")
        hits = F.count_if((label == 1) & (guess == 1))
        test = {r["name"]: r for r in self.scored.where("model = 0").groupBy("name").agg(
            F.avg((label == guess).cast("double")).alias("accuracy"),
            F.coalesce(2 * hits / F.nullif(F.count_if(label == 1) + F.count_if(guess == 1), F.lit(0)),
                       F.lit(0.0)).alias("f1")).collect()}
        area = {(r["name"], r["model"]): r["auc"] for r in scores.auc(
            self.scored, by=["name", "model"]).collect()}  # a row per model and fold
        out = []
        for name in self.models:
            folds = [a for (n, m), a in area.items() if n == name and m > 0 and a is not None]
            out.append({"model": name, "accuracy": test[name]["accuracy"], "auc": area.get((name, 0)),
                        "f1_returned": test[name]["f1"],
                        "cv_auc": sum(folds) / len(folds) if folds else None})
        return out

    @property
    def n_train(self) -> int:
        return self.data.n_rows[0]

    @property
    def n_test(self) -> int:
        return self.data.n_rows[1]

    @property
    def baseline(self) -> float:
        """Accuracy of the most frequent class of the training side."""
        sizes = [n for (test, _), n in self.data.sides.items() if not test]
        return max(sizes, default=0) / max(1, sum(sizes))

    @property
    def best(self) -> str:
        return max(self.results, key=lambda r: -1.0 if r["cv_auc"] is None else r["cv_auc"])["model"]

    def leaderboard(self) -> DataFrame:
        """One row per model and the majority baseline; best by cross-validated AUC. The guard
        against a model without signal is on the best one."""
        rows = [(MAJORITY, self.baseline, 0.5, None, None, False, None)]
        for r in self.results:
            best = r["model"] == self.best
            rows.append((r["model"], r["accuracy"], r["auc"], r["f1_returned"], r["cv_auc"], best,
                         r["cv_auc"] < NO_SIGNAL_AUC if best and r["cv_auc"] is not None else None))
        return self.spark.createDataFrame(
            rows, "model string, accuracy double, auc double, f1_returned double, "
                  "cv_auc double, is_best boolean, no_signal boolean")

    def class_report(self, name: str | None = None) -> DataFrame:
        return scores.class_report(self.predictions[name or self.best])

    def confusion(self, name: str | None = None) -> DataFrame:
        return scores.confusion(self.predictions[name or self.best])

    def roc_points(self, bins: int | None = None) -> DataFrame:
        """ROC points of every model; `bins` puts the scores on a grid for a smaller plot."""
        curves = [scores.roc_points(p, bins=bins).withColumn("model", F.lit(name))
                  for name, p in self.predictions.items()]
        return reduce(DataFrame.unionByName, curves)

    def importances(self, name: str = "Random Forest", top: int = 10) -> DataFrame | None:
        return self._importances(name, top)


class RevenueModels(Fitted):
    """Fits the three regressors. The target is an identity of three features
    (see `checks.is_identity`), so a near-perfect score is arithmetic."""

    def __init__(self, df: DataFrame, trees: int = 100, forest_depth: int | None = None,
                 names: list[str] | None = None, number: Column | None = None):
        self.spark = df.sparkSession
        self.data = Prepared(df.withColumn("label", F.col("TotalPrice").cast("double")),
                             REVENUE_NUMBERS, 5, 5, number, stratify=False,
                             scaled=names is None or "Linear Regression" in names)
        self.models, scored = {}, {}
        blocks = self.data.blocks
        for name in REGRESSORS:
            if names is not None and name not in names:
                continue
            if name == "Linear Regression":
                weights = linear.fit_linear(blocks, 1)
                self.models[name] = weights
                scored[name] = bl.scored_rows(
                    blocks, lambda b, m, w=weights: linear.predict_linear(w, b, m), 1, linear.COLUMNS)
            elif name == "Random Forest":
                self.models[name], scored[name] = self._forest(
                    trees, 1, len(self.data.features.names), forest_depth)
            else:
                self.models[name], scored[name] = self._boosted(trees, 1, logistic=False)
        self.predictions = {n: s.select("label", F.col("score").alias("prediction")) for n, s in scored.items()}

    @cached_property
    def results(self) -> list[dict]:
        whole = reduce(DataFrame.unionByName, [
            p.withColumn("model", F.lit(name)) for name, p in self.predictions.items()])
        found = {r["model"]: r for r in scores.regression_metrics(whole, ["model"]).collect()}
        return [{"model": n, **{k: found[n][k] for k in ("mae", "rmse", "r2")}} for n in self.predictions]

    @property
    def best(self) -> str:
        return max(self.results, key=lambda r: float("-inf") if r["r2"] is None else r["r2"])["model"]

    def leaderboard(self) -> DataFrame:
        rows = [(r["model"], r["mae"], r["rmse"], r["r2"], r["model"] == self.best)
                for r in self.results]
        return self.spark.createDataFrame(
            rows, "model string, mae double, rmse double, r2 double, is_best boolean")

    def importances(self, name: str | None = None, top: int = 10) -> DataFrame | None:
        return self._importances(name or self.best, top)

    def actual_vs_predicted(self, name: str | None = None) -> DataFrame:
        return self.predictions[name or self.best]
