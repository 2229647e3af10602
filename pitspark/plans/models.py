"""Model rungs on walk-forward folds (M1-M12), on Spark SQL and Spark ML.

``rows`` is always the panel joined to its folds: (fold, role, id, features, outcome). Forecasts come
back per test row as q<level> columns, or p_out for probabilities.
"""
from __future__ import annotations

import itertools
import random
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pitspark.functions.ordering import quantiles
from pitspark.functions.scalar import finite, sigmoid
from pitspark.plans import boosting, inference as I, metrics as M
from pitspark.session import durable
from pitspark.sources.predictions import quoted, write_predictions

LEVELS = (0.1, 0.5, 0.9)
ALPHAS = (0.003, 0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0, 30.0)
ROUNDS, PATIENCE = 2000, 50     # of boosting
FIRST = 14                      # rounds beyond the patience of the first run
AT_ONCE = 8                     # fits that run side by side
CONFIGS_AT_ONCE = 2             # of those, on the rows of one fold


def q_name(level: float) -> str:
    return f"q{level:g}"


def of_role(rows: DataFrame, role: str) -> DataFrame:
    return rows.where(F.col("role") == role)


def with_band(scored: DataFrame, y: str, levels: Sequence[float] = LEVELS) -> DataFrame:
    """Test rows of (fold, role, score, y) with quantile columns: the score plus validation residual
    quantiles recentred on their median, per fold, ascending (M8)."""
    named = {f"_o{i}": p for i, p in enumerate(levels)}
    resid = of_role(scored, "val").withColumn("_r", F.col(y) - F.col("score"))
    offs = quantiles(resid, ["fold"], "_r", named).drop("n")
    mid = f"_o{list(levels).index(0.5)}"
    test = of_role(scored, "test").join(F.broadcast(offs), "fold")       # one row per fold
    band = F.array_sort(F.array(*[F.col("score") + F.col(c) - F.col(mid) for c in named]))
    return test.withColumn("_q", band).withColumns(
        {q_name(p): F.col("_q")[i] for i, p in enumerate(levels)}).drop("_q", *named)


# ---- floors ----

def naive_constant(rows: DataFrame, y: str, levels: Sequence[float] = LEVELS,
                   binary: bool = False) -> DataFrame:
    """M1: the training median with a residual band, or the training base rate."""
    if binary:
        rate = of_role(rows, "train").groupBy("fold").agg(
            F.avg((F.col(y) > 0).cast("double")).alias("p_out"))
        return of_role(rows, "test").join(F.broadcast(rate), "fold")
    mid = quantiles(of_role(rows, "train"), ["fold"], y, {"score": 0.5}).drop("n")
    return with_band(rows.join(F.broadcast(mid), "fold"), y, levels)


def standardised(rows: DataFrame, x: str, eps: float = 1e-12) -> DataFrame:
    """Add ``z``: x scaled by the training rows of its fold."""
    m = of_role(rows, "train").groupBy("fold").agg(F.avg(x).alias("_mu"),
                                                   (F.stddev_pop(x) + eps).alias("_sd"))
    return rows.join(F.broadcast(m), "fold").withColumn(
        "z", (F.col(x) - F.col("_mu")) / F.col("_sd")).drop("_mu", "_sd")


def linear_score(rows: DataFrame, x: str, y: str) -> DataFrame:
    """All rows with ``score``, the univariate least-squares fit on their fold's training rows."""
    z = standardised(rows, x)
    fit = of_role(z, "train").groupBy("fold").agg(
        (F.covar_pop("z", y) / F.greatest(F.var_pop("z"), F.lit(1e-12))).alias("_b"),
        F.avg(y).alias("_y"), F.avg("z").alias("_z"))
    return z.join(F.broadcast(fit), "fold").withColumn(
        "score", F.col("_y") - F.col("_b") * F.col("_z") + F.col("_b") * F.col("z")).drop("_b", "_y", "_z")


def naive_feature(rows: DataFrame, x: str, y: str, levels: Sequence[float] = LEVELS) -> DataFrame:
    """M2"""
    return with_band(linear_score(rows, x, y), y, levels)


def logistic_fit(rows: DataFrame, x: str, y: str, steps: int = 25) -> DataFrame:
    """M3: (fold, a, b) of P(y > 0) = sigmoid(a + b z)."""
    train = of_role(standardised(rows, x), "train").select("fold", "z", (F.col(y) > 0).cast("double").alias("up"))
    fits = logistic_weights(train, "fold", ["z"], "up", steps)
    return rows.sparkSession.createDataFrame([(k, *map(float, w)) for k, w in sorted(fits.items())],
                                             "fold int, a double, b double")


def logistic_weights(rows: DataFrame, key: str, features: Sequence[str], up: str, steps: int = 25,
                     close: float = 1e-10) -> dict:
    """Intercept and weights of a logistic regression on any number of features, for every key at once.

    A step is iteratively reweighted least squares: one grouped aggregate gives the weighted normal equations
    of every key, which are as small as the number of features squared. Keys that stand still drop out.
    """
    rows = durable(rows.select(key, up, *features))     # read once a step
    design = [F.lit(1.0), *[F.col(c) for c in features]]
    size = len(design)
    fits = {r[0]: np.zeros(size) for r in rows.select(key).distinct().collect()}
    moving = set(fits)
    for _ in range(steps):
        if not moving:
            break
        weights = rows.sparkSession.createDataFrame(
            [(k, fits[k].tolist()) for k in moving], f"{key} {rows.schema[key].dataType.simpleString()}, _w array<double>")
        eta = reduce(lambda s, i: s + F.col("_w")[i] * design[i], range(1, size), F.col("_w")[0])
        at = rows.join(F.broadcast(weights), key).withColumn("_p", sigmoid(eta))    # one row per key
        spread = F.greatest(F.col("_p") * (1 - F.col("_p")), F.lit(1e-6))
        cells = [(i, j) for i in range(size) for j in range(i, size)]
        sums = at.groupBy(key).agg(
            F.array(*[F.sum((F.col(up) - F.col("_p")) * d) for d in design]).alias("rest"),
            F.array(*[F.sum(spread * design[i] * design[j]) for i, j in cells]).alias("normal")).collect()
        for r in sums:
            normal = np.zeros((size, size))
            for (i, j), v in zip(cells, r["normal"]):
                normal[i, j] = normal[j, i] = v
            move = np.linalg.lstsq(normal, np.array(r["rest"]), rcond=None)[0]
            fits[r[key]] = fits[r[key]] + move
            if np.abs(move).max() < close:
                moving.discard(r[key])
    return fits


def naive_logistic(rows: DataFrame, x: str, y: str, steps: int = 25) -> DataFrame:
    """M3: test rows with p_out."""
    fit = logistic_fit(rows, x, y, steps)
    test = of_role(standardised(rows, x), "test").join(F.broadcast(fit), "fold")
    return test.withColumn("p_out", sigmoid(F.col("a") + F.col("b") * F.col("z"))).drop("a", "b", "z")


# ---- fitted per fold ----

Predictor = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]


def fold_ids(rows: DataFrame) -> list[int]:
    return sorted(r["fold"] for r in rows.select("fold").distinct().collect())


def side_by_side(jobs: Sequence[Callable[[], object]], spark: SparkSession, at_once: int = AT_ONCE) -> list:
    """Results of independent jobs, a bounded number of which run at once: fits of folds and of configurations
    are many small Spark jobs each, which leave most cores idle when they follow one another. Every thread
    has a FAIR pool of its own, where the application's scheduler has that mode."""
    def run(number: int, job: Callable[[], object]) -> Callable[[], object]:
        def own():
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fits-{number % at_once}")
            return job()
        return inheritable_thread_target(spark)(own)

    with ThreadPoolExecutor(max(1, min(at_once, len(jobs)))) as threads:
        return [t.result() for t in [threads.submit(run(i, job)) for i, job in enumerate(jobs)]]


def run_folds(rows: DataFrame, predictor: Predictor, at_once: int = AT_ONCE) -> DataFrame:
    """M8: ``predictor(train, val, test)`` on every fold, forecasts of all test rows together."""
    def one(k: int) -> DataFrame:
        part = rows.where(F.col("fold") == k)
        return predictor(of_role(part, "train"), of_role(part, "val"), of_role(part, "test"))

    parts = side_by_side([partial(one, k) for k in fold_ids(rows)], rows.sparkSession, at_once)
    return reduce(DataFrame.unionByName, parts)


def class_balance_weight(rows: DataFrame, y: str, out: str = "weight") -> DataFrame:
    """Positives weighted by negatives over positives of the fold's training rows."""
    up = F.count_if(F.col(y) > 0)
    w = of_role(rows, "train").groupBy("fold").agg(
        (F.count_if(~(F.col(y) > 0)) / F.greatest(up, F.lit(1))).alias("_w"))
    return rows.join(F.broadcast(w), "fold").withColumn(
        out, F.when(F.col(y) > 0, F.col("_w")).otherwise(1.0)).drop("_w")


def _tree(binary: bool, params: dict, seed: int):
    kind = GBTClassifier if binary else GBTRegressor
    tree = kind(featuresCol="features", labelCol="label", seed=seed, **{"maxDepth": 3, "stepSize": 0.1, **params})
    return tree.setWeightCol("weight") if binary else tree


def _tree_data(train: DataFrame, val: DataFrame, y: str, binary: bool) -> DataFrame:
    both = train.unionByName(val)
    if binary:
        both = class_balance_weight(both, y)
    return both.withColumns({"label": _label(y, binary), "is_val": F.col("role") == "val"})


def _label(y: str, binary: bool) -> Column:
    return (F.col(y) > 0).cast("double") if binary else F.col(y).cast("double")


def _assembled(features: Sequence[str]) -> Pipeline:
    """The feature vector, in which a missing value is 0."""
    names = [f"_x{i}" for i in range(len(features))]
    filled = ", ".join(f"coalesce(nanvl(CAST(`{c}` AS DOUBLE), 0D), 0D) AS `{n}`" for c, n in zip(features, names))
    return Pipeline(stages=[SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__"),
                            VectorAssembler(inputCols=names, outputCol="features")])


def best_round(curve: Sequence[float], patience: int) -> tuple[int, bool]:
    """(best round so far, whether ``patience`` rounds without a better one have followed it), from 1."""
    best = 0
    for i, loss in enumerate(curve):
        if loss < curve[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def first_rounds(model: GBTClassificationModel | GBTRegressionModel, n: int, binary: bool):
    """The model of the first ``n`` rounds of a longer run: its first trees, as a shorter run has the same ones."""
    jvm, gateway, own = SparkSession.active()._jvm, SparkSession.active().sparkContext._gateway, model._java_obj
    ml = jvm.org.apache.spark.ml
    trees, weights = gateway.new_array(ml.regression.DecisionTreeRegressionModel, n), gateway.new_array(jvm.double, n)
    every = own.trees()
    for i, w in enumerate(model.treeWeights[:n]):
        trees[i], weights[i] = every[i], float(w)
    if binary:
        return GBTClassificationModel(ml.classification.GBTClassificationModel(own.uid(), trees, weights))
    return GBTRegressionModel(ml.regression.GBTRegressionModel(own.uid(), trees, weights))


def fit_trees(train: DataFrame, val: DataFrame, y: str, features: Sequence[str], binary: bool = False,
              params: dict | list[dict] | None = None, seed: int = 0, rounds: int = ROUNDS,
              patience: int = PATIENCE) -> PipelineModel | Sequence[PipelineModel]:
    """M4: boosted trees, stopped when the validation loss has not improved for ``patience`` rounds; those up to the best
    round are the model. A list of ``params`` gives a sequence of models, all fitted on one table."""
    configs = params if isinstance(params, list) else [params or {}]
    both = train.unionByName(val).withColumn("_part", F.lit(0))
    models = fit_parts(both, [seed], y, features, binary, configs, rounds, patience)[0]
    return models if isinstance(params, list) else models[0]


def fit_parts(rows: DataFrame, seeds: Sequence[int], y: str, features: Sequence[str], binary: bool = False,
              configs: Sequence[dict] = ({},), rounds: int = ROUNDS, patience: int = PATIENCE) -> list[Sequence[PipelineModel]]:
    """M4 on every ``_part`` (0, 1, ...) of training and validation rows, each with its seed: a model for every configuration."""
    asked = [_tree(binary, {**c, "maxIter": rounds}, seeds[0]) for c in configs]
    inputs = _assembled(features).fit(rows)
    found: list[Sequence[PipelineModel] | None] = [None] * len(seeds)
    if all(_plain_boosting(t) for t in asked):
        found = _boosted_models(rows, seeds, y, inputs, len(features), binary, asked, rounds, patience)
    for k, seed in enumerate(seeds):
        if found[k] is None:
            own = rows.where(F.col("_part") == k).drop("_part")
            data = _tree_data(of_role(own, "train"), of_role(own, "val"), y, binary)
            found[k] = _ml_models(data, inputs, binary, configs, seed, rounds, patience)
    return found


def _ml_models(rows: DataFrame, inputs: PipelineModel, binary: bool, configs: Sequence[dict], seed: int, rounds: int,
               patience: int) -> list[PipelineModel]:
    """Fits of Spark ML, for parameters that ``boosting`` does not have and rows that are refused.

    Boosting of a given seed begins alike whatever the number of rounds, so it runs for a few rounds, is looked
    at round by round, and runs again for twice as many until the patience is used up (at once for all
    rounds where that is no more than twice as many).
    """
    # one vector table, which every run and every round reads
    data = durable(inputs.transform(rows).select("features", "label", "is_val", *["weight"] * binary))
    learn, held = data.where("not is_val"), data.where("is_val")
    if held.isEmpty():
        raise ValueError("early stopping needs validation rows")
    loss = "logistic" if binary else "absolute"

    def one(config: dict) -> PipelineModel:
        n = patience + FIRST if rounds > 2 * (patience + FIRST) else rounds
        while True:
            model = _tree(binary, {**config, "maxIter": n}, seed).fit(learn)
            # the label is scored on both sides alike, so the curve of a longer run starts with that of a shorter one
            best, done = best_round(model.evaluateEachIteration(held, *[] if binary else [loss]), patience)
            if done or n >= rounds:
                break
            n = min(rounds, 2 * n)
        return PipelineModel([*inputs.stages, first_rounds(model, best, binary) if best < n else model])

    return side_by_side([partial(one, c) for c in configs], rows.sparkSession, CONFIGS_AT_ONCE)


def _plain_boosting(tree: GBTClassifier | GBTRegressor) -> bool:
    """Whether ``boosting`` grows such trees: all rows and features in every round, the usual losses, short trees."""
    loss = "logistic" if isinstance(tree, GBTClassifier) else "squared"
    return (tree.getLossType() == loss and tree.getSubsamplingRate() == 1.0 and tree.getFeatureSubsetStrategy() in ("all", "auto")
            and 1 <= tree.getMaxDepth() <= boosting.MOST_DEPTH and tree.getMaxBins() <= boosting.MOST_BINS
            and not tree.isSet("validationIndicatorCol"))


class _Candidates(Sequence):
    """Models of a search with their validation losses. One becomes a model of Spark ML when it is taken out."""
    def __init__(self, losses: Sequence[float], make: Callable[[int], PipelineModel]):
        self.losses, self._make = losses, make

    def __len__(self) -> int:
        return len(self.losses)

    def __getitem__(self, i: int) -> PipelineModel:
        return self._make(range(len(self.losses))[i])


def _boosted_models(rows: DataFrame, seeds: Sequence[int], y: str, inputs: PipelineModel, n_features: int, binary: bool,
                    asked: Sequence[GBTClassifier | GBTRegressor], rounds: int, patience: int) -> list[_Candidates | None]:
    """Nothing for parts with rows that Spark ML refuses or weighs by more than the label."""
    names = [f"_x{i}" for i in range(n_features)]
    named = rows.where(F.col("role").isin("train", "val")).withColumns({"label": _label(y, binary), "is_val": F.col("role") == "val"})
    frame = inputs.stages[0].transform(named).select(F.col("_part").alias("part"), "fold", "is_val", "label", *names)
    odd = reduce(Column.__or__, [~F.coalesce(finite(c), F.lit(False)) for c in ["label", *names]])
    learns = ~F.col("is_val")
    seen = {r["part"]: r for r in frame.groupBy("part").agg(
        F.count_if(learns).alias("n"), F.count_if("is_val").alias("n_val"), F.count_if(learns & (F.col("label") > 0)).alias("up"),
        F.count_if(odd).alias("odd"), F.count_if(F.col("fold").isNull()).alias("no_fold"), F.min("fold").alias("first"),
        F.max("fold").alias("last")).collect()}

    def weights(r) -> tuple[float, float] | None:
        return (1.0, (r["n"] - r["up"]) / max(r["up"], 1)) if binary else None      # as class_balance_weight

    def weighted(r) -> float:
        return r["n"] if not binary else r["n"] - r["up"] + r["up"] * weights(r)[1]

    def plain(r) -> bool:
        return r["n"] > 0 and r["n_val"] > 0 and not r["odd"] and not (
            binary and (r["first"] != r["last"] or r["no_fold"] or r["up"] == r["n"]))

    keys = [k for k in range(len(seeds)) if k in seen and plain(seen[k])]
    place = F.element_at(F.create_map(*[F.lit(v) for k in keys for v in (k, keys.index(k))]), F.col("part")) if keys else None
    fits: dict[tuple[int, int], boosting.Fit] = {}
    cuts: dict[tuple[int, int], list[np.ndarray]] = {}
    for bins in sorted({t.getMaxBins() for t in asked}) if keys else []:
        own = [i for i, t in enumerate(asked) if t.getMaxBins() == bins]
        # candidate cuts are sought in a sample of a fixed size, as by Spark ML
        share = {k: min(1.0, max(bins * bins, 10_000) / seen[k]["n"]) for k in keys}
        taken = [(F.col("part") == k) & (F.lit(True) if share[k] == 1.0 else F.rand(seeds[k]) < share[k]) for k in keys]
        drawn = frame.where(learns & reduce(Column.__or__, taken)).select("part", "label", *names).toArrow()
        which = drawn["part"].to_numpy()
        parts = []
        for k in keys:
            some, r = drawn.filter(pa.array(which == k)), seen[k]
            w = np.array(weights(r))[some["label"].to_numpy().astype(int)] if binary else np.ones(some.num_rows)
            cuts[k, bins] = [boosting.cuts_of(some[c].to_numpy(), w, share[k] * weighted(r), min(bins, r["n"]) - 1) for c in names]
            parts.append(boosting.Part(cuts[k, bins], weights(r), r["n"], r["n_val"]))
        params = [boosting.Params(t.getMaxDepth(), t.getStepSize(), t.getMinInstancesPerNode(), t.getMinWeightFractionPerNode(),
                                  t.getMinInfoGain()) for t in map(asked.__getitem__, own)]
        got = boosting.boost(frame.where(F.col("part").isin(keys)).withColumn("part", place), names, parts, params, rounds,
                             partial(_stop, best_round, patience), side_by_side)
        fits |= {(k, i): f for k, some in zip(keys, got) for i, f in zip(own, some)}

    def make(k: int, i: int) -> PipelineModel:
        fit = fits[k, i]
        return PipelineModel([*inputs.stages, _ml_model(fit.trees[:fit.best], fit.params.step, cuts[k, asked[i].getMaxBins()],
                                                        n_features, binary, asked[i])])

    return [_Candidates([fits[k, i].compared[fits[k, i].best - 1] for i in range(len(asked))], partial(make, k))
            if k in keys else None for k in range(len(seeds))]


def _stop(rule: Callable, patience: int, curve: Sequence[float]) -> tuple[int, bool]:
    return rule(curve, patience)


def _ml_model(trees: Sequence[boosting.Tree], step: float, cuts: Sequence[np.ndarray], n_features: int, binary: bool,
              asked: GBTClassifier | GBTRegressor) -> GBTClassificationModel | GBTRegressionModel:
    """The trees as a model of Spark ML."""
    spark = SparkSession.active()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    ml, impurity = jvm.org.apache.spark.ml, jvm.org.apache.spark.mllib.tree.impurity

    def doubles(values: Sequence[float]):
        out = gateway.new_array(jvm.double, len(values))
        for i, v in enumerate(values):
            out[i] = float(v)
        return out

    def node(tree: boosting.Tree, i: int):
        own = tree[i]
        sums = impurity.VarianceCalculator(doubles([own.w, own.s, own.ss]), own.n)
        if own.feature < 0:
            return ml.tree.LeafNode(own.value, own.impurity, sums)
        at = ml.tree.ContinuousSplit(own.feature, float(cuts[own.feature][own.cut]))
        return ml.tree.InternalNode(own.value, own.impurity, own.gain, node(tree, 2 * i), node(tree, 2 * i + 1), at, sums)

    parts = gateway.new_array(ml.regression.DecisionTreeRegressionModel, len(trees))
    for k, tree in enumerate(trees):
        parts[k] = ml.regression.DecisionTreeRegressionModel(f"dtr_{k}", node(tree, 1), n_features)
    weights = doubles([step if k else 1.0 for k in range(len(trees))])
    own = asked._to_java()
    kind = ml.classification.GBTClassificationModel if binary else ml.regression.GBTRegressionModel
    model = own.copyValues(kind(own.uid(), parts, weights), ml.param.ParamMap.empty())
    return (GBTClassificationModel if binary else GBTRegressionModel)(model)


def score_with(model: PipelineModel, rows: DataFrame, binary: bool = False) -> DataFrame:
    got = model.transform(rows)
    s = vector_to_array("probability")[1] if binary else F.col("prediction")
    return got.withColumn("score", s).select(*rows.columns, "score")


def trees(rows: DataFrame, y: str, features: Sequence[str], levels: Sequence[float] = LEVELS,
          binary: bool = False, params: dict | None = None, seed: int = 0,
          tune: dict[str, Sequence] | None = None, n_configs: int = 0, rounds: int = ROUNDS,
          patience: int = PATIENCE) -> DataFrame:
    """M4, M7: boosted trees on every fold, searched over ``tune`` when given. All folds and configurations
    are fitted side by side."""
    rows, ids = _by_part(rows)
    configs = sample_configs(tune, n_configs, seed) if tune and n_configs else [{}]
    found = fit_parts(rows, [seed] * len(ids), y, features, binary, [{**(params or {}), **c} for c in configs], rounds, patience)
    parts = [[of_role(rows.where(F.col("_part") == k).drop("_part"), r) for r in ("train", "val", "test")] for k in range(len(ids))]

    def best(k: int) -> PipelineModel:
        models = found[k]
        if len(models) == 1:
            return models[0]
        losses = models.losses if isinstance(models, _Candidates) else [
            validation_loss(score_with(m, parts[k][1], binary), y, binary) for m in models]
        return models[min(range(len(models)), key=losses.__getitem__)]      # first among equals

    fits = side_by_side([partial(best, k) for k in range(len(ids))], rows.sparkSession)
    out = []
    for model, (train, val, test) in zip(fits, parts):
        if binary:
            out.append(score_with(model, test, True).withColumnRenamed("score", "p_out"))
        else:
            out.append(with_band(score_with(model, val.unionByName(test)), y, levels))
    return reduce(DataFrame.unionByName, out)


def sample_configs(space: dict[str, Sequence], n: int, seed: int = 0) -> list[dict]:
    """M7: n distinct draws from a discrete space (all of it when it is no larger)."""
    every = [dict(zip(space, c)) for c in itertools.product(*space.values())]
    return random.Random(seed).sample(every, min(n, len(every)))


def validation_loss(scored: DataFrame, y: str, binary: bool) -> float:
    """Log loss of probabilities or mean absolute error, of the ``score`` column."""
    if binary:
        p = F.greatest(F.least("score", F.lit(1 - 1e-7)), F.lit(1e-7))
        loss: Column = -F.log(F.when(F.col(y) > 0, p).otherwise(1 - p))
    else:
        loss = F.abs(F.col(y) - F.col("score"))
    return scored.agg(F.avg(loss)).first()[0]


def fold_models(rows: DataFrame, y: str, features: Sequence[str], binary: bool = False, params: dict | None = None,
                seed: int = 0, rounds: int = ROUNDS, patience: int = PATIENCE) -> dict[int, PipelineModel]:
    """Boosted trees of every fold, fitted side by side."""
    rows, ids = _by_part(rows)
    found = fit_parts(rows, [seed] * len(ids), y, features, binary, [params or {}], rounds, patience)
    return dict(zip(ids, side_by_side([partial(m.__getitem__, 0) for m in found], rows.sparkSession)))


def _by_part(rows: DataFrame) -> tuple[DataFrame, list[int]]:
    """Written rows with the place of their fold among all folds as ``_part``, and the folds."""
    rows = durable(rows)
    ids = fold_ids(rows)
    return rows.withColumn("_part", (F.array_position(F.array(*map(F.lit, ids)), F.col("fold")) - 1).cast("int")), ids


def score_folds(models: dict[int, PipelineModel], rows: DataFrame, binary: bool = False) -> DataFrame:
    """``rows`` with the ``score`` of their own fold's model."""
    return reduce(DataFrame.unionByName, [score_with(m, rows.where(F.col("fold") == k), binary) for k, m in models.items()])


def tree_importances(rows: DataFrame, y: str, features: Sequence[str], binary: bool = False,
                     params: dict | None = None, seed: int = 0, rounds: int = ROUNDS, patience: int = PATIENCE) -> DataFrame:
    """G2 input: (fold, feature, gain) of boosted trees fitted on every fold."""
    models = fold_models(rows, y, features, binary, params, seed, rounds, patience)
    gains = {k: m.stages[-1].featureImportances.toArray() for k, m in models.items()}      # up to the last feature in use
    out = [(k, f, float(g[i]) if i < len(g) else 0.0) for k, g in gains.items() for i, f in enumerate(features)]
    return rows.sparkSession.createDataFrame(out, "fold int, feature string, gain double")


# ---- penalised linear models from sufficient statistics ----

def scaled(rows: DataFrame, features: Sequence[str], eps: float = 1e-9) -> DataFrame:
    """Features less the training mean over the training deviation of their fold, missing ones 0, as ``z``."""
    means = of_role(rows, "train").groupBy("fold").agg(*[e for i, f in enumerate(features) for e in (
        F.avg(quoted(f)).alias(f"_m{i}"), F.stddev_pop(quoted(f)).alias(f"_s{i}"))])
    z = [F.coalesce(F.nanvl((quoted(f).cast("double") - F.col(f"_m{i}")) / (F.col(f"_s{i}") + eps), F.lit(0.0)), F.lit(0.0))
         for i, f in enumerate(features)]
    got = rows.join(F.broadcast(means), "fold")             # one row per fold
    return got.withColumn("z", F.array(*z)).drop(*[f"_{c}{i}" for i in range(len(features)) for c in "ms"])


def gram(train: DataFrame, y: str, size: int) -> DataFrame:
    """(fold, n, yy, m): row count and the sums of products of (1, z, y) with each other, by fold. Sums of a
    partition are taken on whole batches; Spark adds them up cell by cell."""
    def partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            fold = b.column("fold").to_numpy()
            z = b.column("z").flatten().to_numpy().reshape(b.num_rows, size)
            d = np.concatenate([np.ones((b.num_rows, 1)), z, b.column("y").to_numpy()[:, None]], 1)
            for k in np.unique(fold).tolist():
                own = d[fold == k]
                sums[k] = sums.get(k, 0.0) + own.T @ own
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([m.ravel().tolist() for m in sums.values()],
                                                                                     pa.list_(pa.float64()))], ["fold", "m"])

    # the outcome less its mean, so that its squares do not cancel
    mean = train.groupBy("fold").agg(F.avg(quoted(y)).alias("_y"))
    rows = train.join(F.broadcast(mean), "fold").where(finite(quoted(y)))       # one row per fold
    parts = rows.select(F.col("fold").cast("int").alias("fold"), "z", (quoted(y) - F.col("_y")).cast("double").alias("y")
                        ).mapInArrow(partial_sums, "fold int, m array<double>")
    cells = parts.select("fold", F.posexplode("m").alias("i", "v")).groupBy("fold", "i").agg(F.sum("v").alias("v"))
    whole = cells.groupBy("fold").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda c: c["v"]).alias("m"))
    return whole.join(mean, "fold")


def path_weights(m: np.ndarray, model: str, alphas: Sequence[float], tol: float = 1e-12, rounds: int = 20_000) -> np.ndarray:
    """(alphas, features) weights of centred data with the products ``m`` of (1, z, y). Ridge adds alpha |w|^2
    to the summed squares; lasso and elastic net add alpha times their norm (half of each for the latter) to
    half the mean squares, and are solved by coordinate descent from the largest penalty on."""
    n = m[0, 0]
    means = m[0] / n
    c = m / n - np.outer(means, means)
    xx, xy = c[1:-1, 1:-1], c[1:-1, -1]
    if model == "ridge":
        return np.stack([np.linalg.solve(xx + a / n * np.eye(len(xy)), xy) for a in alphas])
    if model not in ("lasso", "elasticnet"):
        raise ValueError("model must be one of ['elasticnet', 'lasso', 'ridge']")
    share = 1.0 if model == "lasso" else 0.5
    out, w = np.zeros((len(alphas), len(xy))), np.zeros(len(xy))
    for i in np.argsort(-np.asarray(alphas)):
        l1, l2 = alphas[i] * share, alphas[i] * (1 - share)
        for _ in range(rounds):
            before = w.copy()
            for j in range(len(w)):
                if xx[j, j] + l2 <= 0:
                    continue
                rest = xy[j] - xx[j] @ w + xx[j, j] * w[j]
                w[j] = np.sign(rest) * max(abs(rest) - l1, 0.0) / (xx[j, j] + l2)
            if np.abs(w - before).max(initial=0.0) < tol:
                break
        out[i] = w
    return out


def penalty_path(rows: DataFrame, y: str, features: Sequence[str], model: str, alphas: Sequence[float]) -> DataFrame:
    """(fold, alpha, intercept, w): the fits of every penalty on the training rows of ``scaled`` rows, all from
    one pass over them; a fold's products are as small as the number of features squared."""
    size = len(features) + 2

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for fold, mean, flat in zip(*(b.column(c).to_pylist() for c in ("fold", "_y", "m"))):
                m = np.array(flat).reshape(size, size)
                for a, w in zip(alphas, path_weights(m, model, alphas)):
                    out.append((fold, float(a), float(mean + (m[0, -1] - m[0, 1:-1] @ w) / m[0, 0]), w.tolist()))
            kinds = [pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)],
                                             ["fold", "alpha", "intercept", "w"])

    sums = gram(of_role(rows, "train"), y, len(features))
    return sums.mapInArrow(solve, "fold int, alpha double, intercept double, w array<double>")


def chosen_fit(rows: DataFrame, y: str, features: Sequence[str], model: str, alphas: Sequence[float]) -> DataFrame:
    """M5: (fold, alpha, intercept, w) of the penalty with the least mean absolute validation error, the first
    among equals. All penalties are scored in one pass over the validation rows."""
    fits = durable(penalty_path(rows, y, features, model, alphas))      # folds x alphas rows
    wide = fits.groupBy("fold").agg(F.transform(F.array_sort(F.collect_list(F.struct(
        F.array_position(F.array(*map(F.lit, map(float, alphas))), F.col("alpha")).alias("i"), "intercept", "w"))),
        lambda f: F.struct(f["i"].alias("i"), f["intercept"].alias("b"), f["w"].alias("w"))).alias("_fits"))
    val = of_role(rows, "val").where(finite(quoted(y))).join(F.broadcast(wide), "fold")     # one row per fold
    errors = val.select("fold", F.explode(F.transform("_fits", lambda f: F.struct(
        f["i"].alias("i"), F.abs(quoted(y) - _score(f["b"], f["w"])).alias("e")))).alias("s"))
    best = errors.groupBy("fold", "s.i").agg(F.avg("s.e").alias("e")).groupBy("fold").agg(F.min(F.struct("e", "i")).alias("best"))
    place = F.get(F.array(*map(F.lit, map(float, alphas))), F.col("best.i").cast("int") - 1)
    return fits.join(best.select("fold", place.alias("alpha")), ["fold", "alpha"])


def _score(intercept: Column, w: Column) -> Column:
    return F.aggregate(F.zip_with(w, F.col("z"), lambda a, b: a * b), intercept, lambda s, x: s + x)


def linear(rows: DataFrame, y: str, features: Sequence[str], model: str = "ridge",
           alphas: Sequence[float] = ALPHAS, levels: Sequence[float] = LEVELS) -> DataFrame:
    """M5 on every fold at once."""
    z = durable(scaled(rows, features))
    fit = chosen_fit(z, y, features, model, alphas).select("fold", F.col("intercept").alias("_b"), F.col("w").alias("_w"))
    scored = z.where("role <> 'train'").join(F.broadcast(fit), "fold")      # one row per fold
    return with_band(scored.withColumn("score", _score(F.col("_b"), F.col("_w"))).drop("_b", "_w", "z"), y, levels)


def coefficients(rows: DataFrame, y: str, features: Sequence[str], model: str = "ridge",
                 alphas: Sequence[float] = ALPHAS) -> DataFrame:
    """M6: standardised coefficients, mean and std over folds, largest magnitude first."""
    fits = chosen_fit(durable(scaled(rows, features)), y, features, model, alphas)
    named = F.arrays_zip(F.array(*map(F.lit, features)).alias("feature"), F.col("w").alias("c"))
    table = fits.select("fold", F.inline(named))
    return (table.groupBy("feature").agg(F.avg("c").alias("coef"), F.stddev_samp("c").alias("coef_std"))
            .orderBy(F.desc(F.abs("coef")), "feature"))


def ensemble_mean(members: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Mean forecast of several fits per row."""
    return members.groupBy(*keys).agg(*[F.avg(F.col(f"`{c}`")).alias(c) for c in cols])


def ladder(rungs: dict[str, Callable[[], DataFrame]], y: str, levels: Sequence[float] = LEVELS,
           binary: bool = False, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """M9: run named rungs, keep their predictions, and report per rung the fold mean and std, the pooled
    value and a HAC t-test of the quarterly IC series."""
    cols = ["p_out"] if binary else [q_name(p) for p in sorted(levels)]
    preds = None
    for name, run in rungs.items():
        got = run().select("id", F.col("d").alias("date"), "grp", "fold", F.col(y).alias("y_true"),
                           *[F.col(f"`{c}`") for c in cols])
        if path:
            write_predictions(got, path, name)
        got = got.withColumn("rung", F.lit(name))
        preds = got if preds is None else preds.unionByName(got)
    preds = preds.sparkSession.read.parquet(path).where(
        F.col("rung").isin(*rungs)) if path else durable(preds)
    return preds, ladder_report(preds, cols, sorted(levels), binary)


def ladder_report(preds: DataFrame, cols: Sequence[str], levels: Sequence[float],
                  binary: bool = False) -> DataFrame:
    def score(keys):
        if binary:
            return M.evaluate_binary(preds, keys, "y_true")
        return M.evaluate(preds, keys, "y_true", cols, levels)

    wanted = (["rank_ic", "auc", "accuracy", "quintile_spread", "brier", "logloss"] if binary else
              ["rank_ic", "hit_rate", "decile_spread", "mae", "pinball", "coverage"])
    point = cols[0] if binary else q_name(0.5)
    # three short tables that do not wait for each other
    by_fold, whole, tt = side_by_side([
        lambda: durable(score(["rung", "fold"])), lambda: durable(score(["rung"])), lambda: durable(I.t_test(
            M.ic_by_period(preds, ["rung"], point, "y_true"), ["rung"], "rank_ic", "period"))], preds.sparkSession)
    folds = M.aggregate_folds(M.long_metrics(by_fold, ["rung", "fold"]))
    pooled = M.long_metrics(whole, ["rung"]).withColumnRenamed("value", "pooled")
    return (folds.where(F.col("metric").isin(*wanted)).join(pooled, ["rung", "metric"])
            .join(tt.select("rung", F.col("n").alias("ic_periods"), F.col("t").alias("ic_t"),
                            F.col("p").alias("ic_p")), "rung", "left"))


# ---- deployment ----

def fit_final(panel: DataFrame, split: DataFrame, y: str, features: Sequence[str], path: str,
              binary: bool = False, params: dict | None = None, seeds: Sequence[int] = (0,), rounds: int = ROUNDS,
              patience: int = PATIENCE) -> None:
    """One model per seed on all rows (V3 split), saved with the feature contract."""
    rows = durable(panel.select(*dict.fromkeys(["id", y, *features])).join(split, "id"))

    every = rows.withColumn("_part", F.explode(F.array(*[F.lit(k) for k in range(len(seeds))])))
    found = fit_parts(every, seeds, y, features, binary, [params or {}], rounds, patience)

    def one(k: int) -> None:
        found[k][0].write().overwrite().save(f"{path}/seed={seeds[k]}")

    side_by_side([partial(one, k) for k in range(len(seeds))], panel.sparkSession)
    offsets = None
    if not binary:
        scored = _mean_score(rows, path, seeds, False)
        resid = of_role(scored, "val").withColumn("_r", F.col(y) - F.col("score"))
        offsets = quantiles(resid, [], "_r", {q_name(p).replace(".", "_"): p for p in LEVELS}).drop("n").first()
    meta = [(i, f, bool(binary), ",".join(map(str, seeds)), [float(v) for v in offsets] if offsets else None)
            for i, f in enumerate(features)]
    panel.sparkSession.createDataFrame(
        meta, "i int, feature string, binary boolean, seeds string, offsets array<double>"
    ).coalesce(1).write.mode("overwrite").parquet(f"{path}/contract")


def _mean_score(rows: DataFrame, path: str, seeds: Sequence[int], binary: bool) -> DataFrame:
    out, cols = rows, rows.columns
    for i, s in enumerate(seeds):
        out = score_with(PipelineModel.load(f"{path}/seed={s}"), out, binary).withColumnRenamed(
            "score", f"_s{i}")
    mean = sum((F.col(f"_s{i}") for i in range(1, len(seeds))), F.col("_s0")) / len(seeds)
    return out.select(*cols, mean.alias("score"))


def score_new(panel: DataFrame, path: str, features: Sequence[str]) -> DataFrame:
    """Forecasts of a saved model for rows with or without labels. ``features`` are the names the panel
    is built with now; missing, new or reordered ones against the stored contract raise (X6)."""
    from pitspark.plans.scaling import schema_guard

    meta = panel.sparkSession.read.parquet(f"{path}/contract").orderBy("i").collect()
    wanted = [m["feature"] for m in meta]
    schema_guard({"features": [f for f in features if f in panel.columns]}, {"features": wanted})
    seeds = [int(s) for s in meta[0]["seeds"].split(",")]
    got = _mean_score(panel, path, seeds, meta[0]["binary"])
    if meta[0]["binary"]:
        return got.withColumnRenamed("score", "p_out")
    off = meta[0]["offsets"]
    mid = off[LEVELS.index(0.5)]
    for p, o in zip(LEVELS, off):
        got = got.withColumn(f"q{round(p * 100)}", F.col("score") + (o - mid))
    return got.withColumns({f"mult_q{round(p * 100)}": F.exp(f"q{round(p * 100)}") for p in LEVELS}).drop("score")


def fit_bundle(panel: DataFrame, split: DataFrame, horizons: Sequence[int], features: Sequence[str], path: str,
               **options) -> None:
    """A stored bundle with one ``fit_final`` per horizon, side by side, each on the rows that have its label."""
    split = durable(split)

    def one(h: int) -> None:
        fit_final(panel.where(finite(f"y_{h}")), split, f"y_{h}", features, f"{path}/horizon={h}", **options)

    side_by_side([partial(one, h) for h in horizons], panel.sparkSession)
    panel.sparkSession.createDataFrame([(int(h),) for h in sorted(horizons)], "horizon int").coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/horizons")


def score_bundle(panel: DataFrame, path: str, features: Sequence[str], new_only: bool = True) -> DataFrame:
    """Forecasts of a stored bundle for the rows of an inference panel: (id, d, grp) with p_out_<h> of every
    horizon, or the quantiles and multiples of the main (longest) one. ``new_only`` takes rows without
    a label of the main horizon, which no model can have been fitted on."""
    horizons = [r["horizon"] for r in panel.sparkSession.read.parquet(f"{path}/horizons").collect()]     # a handful
    main = max(horizons)
    rows = panel.where(~F.coalesce(finite(f"y_{main}"), F.lit(False))) if new_only else panel
    out = rows.select("id", "d", "grp", *[quoted(f) for f in features])
    names = []
    for h in sorted(horizons):
        got = score_new(out, f"{path}/horizon={h}", features)
        if "p_out" in got.columns:
            out = got.withColumnRenamed("p_out", f"p_out_{h}")
            names.append(f"p_out_{h}")
        elif h == main:
            names = [c for c in got.columns if c not in out.columns]
            out = got
    return out.select("id", "d", "grp", *names)
