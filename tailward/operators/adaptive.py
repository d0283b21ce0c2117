"""Adaptive warnings: a supervised score per bar and the threshold that suits it best."""

from __future__ import annotations

from datetime import datetime

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailward.functions.time import interval
from tailward.session import stage

REG_GRID = [0.001, 0.01, 0.1, 1.0]
TAUS = [round(i / 100, 2) for i in range(1, 100)]


def bc_fit(df: DataFrame, features: list[str], label: str = "label", reg: float = 0.01) -> PipelineModel:
    """Behaviour cloning as a classifier of the exogenous label.

    ``df`` must hold the training period only. Missing values become the training
    median; regularisation keeps the coefficients finite on separable labels.
    """
    return bc_fits(df, features, [reg], label)[0]


def bc_fits(df: DataFrame, features: list[str], regs: list[float], label: str = "label") -> list[PipelineModel]:
    """``bc_fit`` for each regularisation; medians and scales are found once."""
    train = df.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias(label))
    known = train.agg(*[F.count(c).alias(c) for c in features]).first()
    usable = [c for c in features if known[c] > 0]  # a column without any value has no median
    filled = [f"{c}_filled" for c in usable]
    steps = [
        Imputer(inputCols=usable, outputCols=filled, strategy="median"),
        VectorAssembler(inputCols=filled, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True),
    ]
    prepared = Pipeline(stages=steps).fit(train)
    scaled = prepared.transform(train).select("_scaled", label)
    fit = lambda reg: LogisticRegression(featuresCol="_scaled", labelCol=label, regParam=reg, probabilityCol="_prob", maxIter=50).fit(scaled)
    return [PipelineModel(stages=[*prepared.stages, fit(reg)]) for reg in regs]


def with_folds(df: DataFrame, folds: int, order: str = "bar") -> tuple[DataFrame, list[datetime]]:
    """Add ``fold`` by equal spans of time, and the start of each: 0 is only learned from, 1 to ``folds`` are judged on."""
    span = df.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    if span["lo"] is None:
        return df.withColumn("fold", F.lit(None).cast("int")), []
    step = (span["hi"] - span["lo"]) / (folds + 1)
    starts = [span["lo"] + step * i for i in range(folds + 1)]
    reached = [(F.col(order) >= F.lit(t).cast("timestamp_ntz")).cast("int") for t in starts[1:]]
    return df.withColumn("fold", sum(reached, F.lit(0))), starts


def tuning_sweep(
    df: DataFrame, features: list[str], grid: list[float] = REG_GRID, folds: int = 3, horizon: str = "4 hours", label: str = "label", order: str = "bar"
) -> DataFrame:
    """Walk-forward choice of the regularisation: one row per fold and grid point, ``chosen`` where its loss is the fold's lowest.

    A fold is judged by models that saw earlier folds only. A label looks ``horizon`` ahead, so
    bars whose horizon reaches into the fold are left out of its training. Losses are the mean
    log loss; equal ones go to the stronger regularisation. A fold whose training or own rows
    hold a single label has no loss and no choice.

    Result: ``fold``, ``reg``, ``n_train``, ``n_valid``, ``train_end``, ``valid_start``, ``log_loss``, ``chosen``.
    """
    spark = df.sparkSession
    folded, starts = with_folds(df.where(F.col(label).isNotNull()), folds, order)
    rows = stage(folded.select("fold", order, *features, label), "folds")
    result = []
    for fold, begin in enumerate(starts[1:], 1):
        train = rows.where((F.col("fold") < fold) & (F.col(order) + interval(horizon) <= F.lit(begin).cast("timestamp_ntz")))
        valid = rows.where(F.col("fold") == fold)
        seen = train.agg(F.count("*").alias("n"), F.sum(label).alias("ones"), F.max(order).alias("end")).first()
        judged = valid.agg(F.count("*").alias("n"), F.min(order).alias("start")).first()
        losses = dict.fromkeys(grid)
        if judged["n"] and seen["ones"] and seen["ones"] < seen["n"]:
            models = bc_fits(train, features, grid, label)
            p = lambda i: F.least(F.greatest(F.col(f"p_{i}"), F.lit(1e-15)), F.lit(1 - 1e-15))
            scored = valid
            for i, model in enumerate(models):
                scored = bc_score(model, scored, f"p_{i}")
            loss = lambda i: F.avg(-F.when(F.col(label) == 1, F.ln(p(i))).otherwise(F.ln(1 - p(i)))).alias(f"loss_{i}")
            losses = dict(zip(grid, scored.agg(*[loss(i) for i in range(len(grid))]).first(), strict=True))
        known = [(round(loss, 9), -reg) for reg, loss in losses.items() if loss is not None]
        best = -min(known)[1] if known else None
        for reg, loss in losses.items():
            result.append((fold, float(reg), seen["n"], judged["n"], seen["end"], judged["start"], loss, reg == best))
    return spark.createDataFrame(result, "fold int, reg double, n_train bigint, n_valid bigint, train_end timestamp_ntz, valid_start timestamp_ntz, log_loss double, chosen boolean")


def bc_coefficients(model: PipelineModel, df: DataFrame) -> DataFrame:
    """The fitted weights, one row per z-score of ``df``, with the intercept; null for a feature that had no value to learn from."""
    lr, names = model.stages[-1], model.stages[0].getInputCols()
    rows = [(n.removeprefix("z_"), float(w)) for n, w in zip(names, lr.coefficients)] + [("(intercept)", float(lr.intercept))]
    rows += [(c.removeprefix("z_"), None) for c in df.columns if c.startswith("z_") and c not in names]
    return df.sparkSession.createDataFrame(rows, "feature string, weight double")


def bc_gradient(model: PipelineModel, df: DataFrame, label: str = "label") -> DataFrame:
    """Gradient of the regularised mean log loss at the fitted weights, one row per weight: near zero if the fit is done."""
    lr, names = model.stages[-1], model.stages[0].getInputCols()
    lost = F.get(vector_to_array("_prob"), F.lit(1)) - F.col(label).cast("double")
    x = vector_to_array("_scaled")
    terms = [F.avg(lost * F.get(x, F.lit(i))) + F.lit(lr.getRegParam() * float(w)) for i, w in enumerate(lr.coefficients)]
    cells = [F.struct(F.lit(n.removeprefix("z_")).alias("feature"), t.alias("gradient")) for n, t in zip(names, terms, strict=True)]
    cells.append(F.struct(F.lit("(intercept)").alias("feature"), F.avg(lost).alias("gradient")))
    return model.transform(df).agg(F.array(*cells).alias("rows")).select(F.inline("rows"))


def bc_score_by_weights(model: PipelineModel, df: DataFrame, out: str = "score") -> DataFrame:
    """The probability of the label written out: medians for missing values, scaling, weights, logistic curve."""
    imputer, _, scaler, lr = model.stages
    medians = imputer.surrogateDF.first()
    total = F.lit(float(lr.intercept))
    for c, mean, std, w in zip(imputer.getInputCols(), scaler.mean, scaler.std, lr.coefficients, strict=True):
        filled = F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(float(medians[c])))
        total = total + (filled - float(mean)) * (float(w) / float(std) if std else 0.0)
    return df.withColumn(out, F.lit(1.0) / (F.lit(1.0) + F.exp(-total)))


def bc_score(model: PipelineModel, df: DataFrame, out: str = "score") -> DataFrame:
    """Add the probability of the label."""
    keep = df.columns
    scored = model.transform(df)
    return scored.select(*keep, F.get(vector_to_array("_prob"), F.lit(1)).alias(out))


def _counts(by: list[str], tp: Column, fp: Column, positives: Column) -> list[Column]:
    precision, recall = F.try_divide(tp, tp + fp), F.try_divide(tp, positives)
    f1 = F.try_divide(tp * 2, tp + fp + positives)
    return [
        tp.alias("tp"),
        fp.alias("fp"),
        (positives - tp).alias("fn"),
        precision.alias("precision"),
        recall.alias("recall"),
        f1.alias("f1"),
    ]


def tau_sweep(df: DataFrame, score: str = "score", label: str = "label", grid: list[float] = TAUS, by: tuple[str, ...] = ("variety",)) -> DataFrame:
    """TP, FP, FN, precision, recall and F1 for each threshold; a row alerts when ``score >= tau``.

    Rows are not multiplied by the grid: each falls into the step of the highest
    threshold it reaches, steps are counted with map-side combination, and a running
    sum over the steps (at most the grid's length per group) gives every threshold.
    """
    taus, by = sorted(grid), list(by)
    steps = F.array(*[F.lit(t) for t in taus])
    rank = sum(((F.round(score, 6) >= F.lit(t)).cast("int") for t in taus), F.lit(0))
    reached = F.coalesce(rank, F.lit(0))
    counts = df.groupBy(*by, reached.alias("_step")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg")
    )
    grid_rows = F.posexplode(steps).alias("_at", "tau")
    cells = counts.select(*by).distinct() if by else counts.agg(F.count(F.lit(1)))
    rows = cells.select(*by, grid_rows).select(*by, (F.col("_at") + 1).alias("_step"), "tau")
    full = rows.join(counts, [*by, "_step"], "full_outer").na.fill(0, ["_pos", "_neg"])
    down = Window.partitionBy(*by).orderBy(F.col("_step").desc()).rowsBetween(Window.unboundedPreceding, 0)
    all_rows = Window.partitionBy(*by)
    return (
        full.withColumn("_tp", F.sum("_pos").over(down))
        .withColumn("_fp", F.sum("_neg").over(down))
        .withColumn("_all", F.sum("_pos").over(all_rows))
        .where(F.col("tau").isNotNull())
        .select(*by, "tau", *_counts(by, F.col("_tp"), F.col("_fp"), F.col("_all")))
    )


def tau_star(sweep: DataFrame, by: tuple[str, ...] = ("variety",)) -> DataFrame:
    """The threshold of the best F1 per group; ties go to the lowest, and a null F1 comes last."""
    w = Window.partitionBy(*by).orderBy(F.round("f1", 9).desc_nulls_last(), F.col("tau"))
    best = sweep.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") == 1)
    return best.select(*by, F.col("tau").alias("tau_star"), F.col("f1").alias("best_f1"))


def double_confirm(scores: DataFrame, rules: DataFrame, taus: DataFrame, min_level: int = 1, score: str = "score") -> DataFrame:
    """Alert where the score reaches the variety's threshold and the rule level confirms it."""
    level = rules.select("variety", "bar", F.col("level").alias("rule_level"))
    reached = F.round(F.col(score), 6) >= F.col("tau_star")
    confirmed = F.col("rule_level") >= min_level
    joined = scores.join(level, ["variety", "bar"], "left").join(taus.select("variety", "tau_star"), "variety", "left")
    return joined.withColumn("alert", F.coalesce(reached & confirmed, F.lit(False)))


def f1_gain(df: DataFrame, taus: DataFrame, fixed_tau: float = 0.5, score: str = "score", label: str = "label") -> DataFrame:
    """F1 with each variety's own threshold against F1 with a fixed one, over all rows of ``df``.

    ``df`` must hold the scored period only; ``taus`` come from the training period.
    """
    s = F.round(F.col(score), 6)
    joined = df.join(taus.select("variety", "tau_star"), "variety", "left")
    positive = F.col(label) == 1
    adaptive, fixed = F.coalesce(s >= F.col("tau_star"), F.lit(False)), s >= F.lit(fixed_tau)

    def f1(alert: Column) -> Column:
        return F.try_divide(F.count_if(alert & positive) * 2, F.count_if(alert) + F.count_if(positive))

    return joined.agg(f1(adaptive).alias("f1_adaptive"), f1(fixed).alias("f1_fixed")).withColumn(
        "gain", F.try_divide(F.col("f1_adaptive"), F.col("f1_fixed")) - 1
    )
