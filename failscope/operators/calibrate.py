"""Calibration: weights of kinds from labelled traces, scores, and cross-validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from failscope.operators.model import KEY


def observations(labels: DataFrame, events: DataFrame) -> DataFrame:
    """(traj_key, label, kind): each kind that fired on a labelled trace once."""
    return labels.select(KEY, "label").join(events.select(KEY, "kind").distinct(), KEY)


def _log_ratio(pos: Column, neg: Column, n_pos: Column, n_neg: Column, smoothing: float) -> Column:
    return F.ln(((pos + smoothing) / (n_pos + 2 * smoothing)) / ((neg + smoothing) / (n_neg + 2 * smoothing)))


def _class_sizes(labels: DataFrame) -> DataFrame:
    sizes = labels.agg(F.count_if("label").alias("n_pos"), F.count_if(~F.col("label")).alias("n_neg"))
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return sizes.where(F.when(both, F.lit(True)).otherwise(F.raise_error(F.lit("need at least one failed and one successful run to fit")).cast("boolean")))


def fit(labels: DataFrame, events: DataFrame, smoothing: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Model of ``labels`` (traj_key, label): weights (kind, log_ratio) and bias (bias), one row.

    Reading it fails if a class is empty.
    """
    sizes = _class_sizes(labels)
    fired = observations(labels, events).groupBy("kind").agg(F.count_if("label").alias("pos"), F.count_if(~F.col("label")).alias("neg"))
    weights = fired.crossJoin(F.broadcast(sizes)).select("kind", _log_ratio(F.col("pos"), F.col("neg"), F.col("n_pos"), F.col("n_neg"), smoothing).alias("log_ratio"))
    return weights, sizes.select(F.ln(F.col("n_pos") / F.col("n_neg")).alias("bias"))


def top_weights(weights: DataFrame, limit: int = 10) -> DataFrame:
    """The weights of greatest size; ties by kind."""
    return weights.orderBy(F.desc(F.abs("log_ratio")), "kind").limit(limit)


def scores(traces: DataFrame, events: DataFrame, weights: DataFrame, bias: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(traj_key, confidence, failed): logistic of the bias and the weights of the distinct kinds; kinds
    without weight count 0. ``weights`` has a row a kind of signal, so Spark broadcasts it by size."""
    fired = events.select(KEY, "kind").distinct().join(weights, "kind", "left").groupBy(KEY).agg(F.sum(F.coalesce("log_ratio", F.lit(0.0))).alias("__sum"))
    total = F.col("bias") + F.coalesce("__sum", F.lit(0.0))
    scored = traces.select(KEY).distinct().join(fired, KEY, "left").crossJoin(F.broadcast(bias)).withColumn("confidence", F.lit(1.0) / (F.lit(1.0) + F.exp(-total)))
    return scored.select(KEY, "confidence", (F.col("confidence") >= threshold).alias("failed"))


def cross_validate(labels: DataFrame, events: DataFrame, folds: int = 5, threshold: float = 0.5, smoothing: float = 1.0) -> DataFrame:
    """Stratified cross-validation, all folds in one plan: recall, false_positive_rate, precision, f1,
    n_positive, n_negative, folds.

    ``labels``: traj_key, label, pos (position of the input, which deals each class to the folds in
    turn). The counts that a fold trains on are the totals less its own. Folds whose training part
    lacks a class are left out; kinds that never fire in it weigh 0.
    """
    sizes = labels.agg(F.count_if("label").alias("__p"), F.count_if(~F.col("label")).alias("__n"))
    sizes = sizes.withColumn("folds", F.greatest(F.lit(2), F.least(F.lit(folds), F.col("__p"), F.col("__n"))).cast("int"))
    turn = Window.partitionBy("label").orderBy("pos")
    dealt = labels.crossJoin(F.broadcast(sizes)).withColumn("fold", ((F.row_number().over(turn) - 1) % F.col("folds")).cast("int")).select(KEY, "label", "fold", "folds", "__p", "__n")

    # one row a fold: what it trains on
    held = dealt.groupBy("fold", "folds", "__p", "__n").agg(F.count_if("label").alias("__fp"), F.count_if(~F.col("label")).alias("__fn"))
    train = held.select("fold", (F.col("__p") - F.col("__fp")).alias("n_pos"), (F.col("__n") - F.col("__fn")).alias("n_neg")).where("n_pos > 0 and n_neg > 0")
    # one row a kind and fold, folds where a kind doesn't fire included
    fired = dealt.join(events.select(KEY, "kind").distinct(), KEY).groupBy("kind", "fold").agg(F.count_if("label").alias("fp"), F.count_if(~F.col("label")).alias("fn"))
    total = fired.groupBy("kind").agg(F.sum("fp").alias("tp"), F.sum("fn").alias("tn"))
    grid = total.crossJoin(F.broadcast(train)).join(fired, ["kind", "fold"], "left").select(
        "kind", "fold", "n_pos", "n_neg", (F.col("tp") - F.coalesce("fp", F.lit(0))).alias("pos"), (F.col("tn") - F.coalesce("fn", F.lit(0))).alias("neg")
    )
    weights = grid.where("pos + neg > 0").select("kind", "fold", _log_ratio(F.col("pos"), F.col("neg"), F.col("n_pos"), F.col("n_neg"), smoothing).alias("log_ratio"))

    sums = dealt.join(events.select(KEY, "kind").distinct(), KEY).join(weights, ["kind", "fold"]).groupBy(KEY).agg(F.sum("log_ratio").alias("__sum"))
    scored = dealt.join(train, "fold").join(sums, KEY, "left")
    confidence = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.ln(F.col("n_pos") / F.col("n_neg")) + F.coalesce("__sum", F.lit(0.0)))))
    counted = scored.withColumn("__said", confidence >= threshold).agg(F.max("folds").alias("folds"), *confusion(F.col("label"), F.col("__said")))
    return counted.select(*rates(), "folds")


def confusion(truth: Column, said: Column) -> list[Column]:
    return [F.count_if(truth & said).alias("tp"), F.count_if(truth & ~said).alias("fn"), F.count_if(~truth & said).alias("fp"), F.count_if(~truth & ~said).alias("tn")]


def rates() -> list[Column]:
    """Rates of the columns tp, fn, fp and tn; 0 where a rate is undefined."""
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), F.lit(0.0))
    recall, precision = share("tp", "fn"), share("tp", "fp")
    f1 = F.coalesce(F.try_divide(F.lit(2.0) * precision * recall, precision + recall), F.lit(0.0))
    return [recall.alias("recall"), share("fp", "tn").alias("false_positive_rate"), precision.alias("precision"), f1.alias("f1"), (F.col("tp") + F.col("fn")).alias("n_positive"), (F.col("fp") + F.col("tn")).alias("n_negative")]
