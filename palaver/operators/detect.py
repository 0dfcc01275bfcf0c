"""Detection quality: confusion counts, false accepts per hour, threshold sweeps, ensembles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from palaver.functions.numbers import rounded

STEPS = 19


def rates(rows: DataFrame) -> DataFrame:
    """precision, recall and f1 beside tp, fp, fn; 0 where a denominator is 0."""
    p = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0))
    r = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(F.col("tp") * 2.0, F.col("tp") * 2 + F.col("fp") + F.col("fn")), F.lit(0.0))
    return rows.withColumns({"precision": rounded(p, 3), "recall": rounded(r, 3), "f1": rounded(f1, 3)})


def _counts(predicted: Column):
    expected = F.col("expected")
    return [
        F.count_if(expected & predicted).alias("tp"), F.count_if(~expected & predicted).alias("fp"),
        F.count_if(~expected & ~predicted).alias("tn"), F.count_if(expected & ~predicted).alias("fn"), F.count("*").alias("n"),
    ]


def confusion(scored: DataFrame, threshold: float = 0.5, by: str = "trigger_type") -> DataFrame:
    """Counts and rates overall and by type, in one pass."""
    rows = scored.rollup(by).agg(*_counts(F.col("score") > threshold))
    return rates(rows.withColumn("bucket", F.coalesce(by, F.lit("overall"))).drop(by))


def false_accepts(scored: DataFrame, threshold: float, seconds: str = "seconds") -> DataFrame:
    """False accepts per hour of recording and of speech that is not addressed."""
    fp = F.count_if(~F.col("expected") & (F.col("score") > threshold))
    rows = scored.agg(fp.alias("fp"), (F.sum(seconds) / 3600).alias("hours"), (F.sum(F.when(~F.col("expected"), F.col(seconds))) / 3600).alias("speech_hours"))
    return per_hour(rows)


def per_hour(rows: DataFrame) -> DataFrame:
    rate = lambda h: rounded(F.coalesce(F.try_divide(F.col("fp"), F.nullif(F.col(h), F.lit(0.0))), F.lit(0.0)), 4)
    return rows.withColumns({"fa_per_hour": rate("hours"), "fa_per_speech_hour": rate("speech_hours")})


def sweep(scored: DataFrame, seconds: str = "seconds", steps: int = STEPS) -> DataFrame:
    """One row per threshold k / (steps + 1).

    Each record is counted once, under the number of thresholds its score exceeds; running
    sums over those few counts give every threshold. No record is multiplied.
    """
    # The same comparison as score > threshold, so that rounding of the thresholds is the same.
    above = sum((F.col("score") > k / (steps + 1)).cast("int") for k in range(1, steps + 1))
    counts = scored.groupBy(above.alias("k")).agg(
        F.count_if("expected").alias("positives"), F.count_if(~F.col("expected")).alias("negatives"),
        F.sum(seconds).alias("s"), F.sum(F.when(~F.col("expected"), F.col(seconds))).alias("quiet"),
    )
    spark = scored.sparkSession
    grid = spark.range(1, steps + 1).select(F.col("id").cast("int").alias("i"), (F.col("id") / float(steps + 1)).alias("threshold"))
    rows = grid.join(F.broadcast(counts), F.lit(True)).groupBy("i", "threshold").agg(
        F.sum(F.when(F.col("k") >= F.col("i"), F.col("positives")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("k") >= F.col("i"), F.col("negatives")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("k") < F.col("i"), F.col("negatives")).otherwise(0)).alias("tn"),
        F.sum(F.when(F.col("k") < F.col("i"), F.col("positives")).otherwise(0)).alias("fn"),
        (F.sum("s") / 3600).alias("hours"), (F.sum("quiet") / 3600).alias("speech_hours"),
    )
    return per_hour(rates(rows)).drop("i", "hours", "speech_hours")


def best_threshold(swept: DataFrame, low_false_accepts: bool = False, default: float = 0.5) -> DataFrame:
    """One row: the threshold of the best rounded f1, the lowest of equals, or the one of fewest false accepts."""
    tie = F.struct("f1", -F.col("fp"), -F.col("threshold")) if low_false_accepts else F.struct("f1", (-F.col("threshold")).alias("t"))
    row = swept.agg(F.max_by("threshold", tie).alias("t"), F.max("f1").alias("f1"))
    return row.select(F.when(F.col("f1") > 0, F.col("t")).otherwise(F.lit(default)).alias("threshold"), "f1")


def mark_best(swept: DataFrame) -> DataFrame:
    order = Window.orderBy(F.col("f1").desc(), "threshold")
    return swept.withColumn("is_best", (F.row_number().over(order) == 1) & (F.col("f1") > 0))


def ensemble(scores: DataFrame, key, value: str = "score") -> DataFrame:
    """Mean over the models of each record."""
    rest = [c for c in scores.columns if c not in (*key, value, "model")]
    return scores.groupBy(*key).agg(F.avg(value).alias(value), *(F.first(c).alias(c) for c in rest))


def transfer(chosen_on: DataFrame, applied_to: DataFrame) -> DataFrame:
    """The threshold chosen on one split, and the counts it gives on the other."""
    best = best_threshold(sweep(chosen_on)).select("threshold")
    rows = applied_to.join(F.broadcast(best), F.lit(True))
    return rates(rows.groupBy("threshold").agg(*_counts(F.col("score") > F.col("threshold"))))


def score_distribution(scored: DataFrame) -> DataFrame:
    positive = F.when(F.col("expected"), F.col("score"))
    return scored.agg(F.avg(positive).alias("mean_positive"), F.min(positive).alias("min_positive"), F.max(positive).alias("max_positive"), F.avg(F.when(~F.col("expected"), F.col("score"))).alias("mean_negative"))


def sigmoid(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def weighted_loss(logit: Column, label: Column, positive_weight: float, smoothing: float = 0.0) -> Column:
    """Binary cross-entropy of a logit with a weight on positives and label smoothing."""
    y = label * (1 - smoothing) + smoothing / 2
    softplus = lambda x: F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
    return positive_weight * y * softplus(-logit) + (1 - y) * softplus(logit)


def cross_entropy(logits: Column, label: Column, smoothing: float = 0.0) -> Column:
    """Cross-entropy of an array of class logits with the label's position, smoothed over the classes."""
    top = F.array_max(logits)
    total = top + F.log(F.aggregate(F.transform(logits, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x))
    mean = F.aggregate(logits, F.lit(0.0), lambda a, x: a + x) / F.size(logits)
    return total - (1 - smoothing) * F.get(logits, label) - smoothing * mean


def learning_rate(step: Column, warmup: int, total: int, peak: float) -> Column:
    """Linear warm-up, then half a cosine down to 0."""
    done = F.least(F.lit(1.0), (step - warmup) / max(1, total - warmup))
    return F.when(step < warmup, peak * step / max(1, warmup)).otherwise(peak * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * done)))


def early_stop(results: DataFrame, most: int = 3, span: int = 1 << 20) -> DataFrame:
    """Rows up to and with the one at which `most` failures in a row were reached (columns seq, a long, and ok).

    Windows run within stretches of `span` numbers; one row for each stretch says how many failures
    it carries on from those before it, so no task orders all rows.
    """
    rows = results.withColumn("_part", F.floor(F.col("seq") / span))
    within = Window.partitionBy("_part").orderBy("seq")
    rows = rows.withColumn("_oks", F.sum(F.col("ok").cast("int")).over(within))
    tail = F.max(F.when(F.col("ok"), F.col("seq")))
    parts = rows.groupBy("_part").agg(F.count("*").alias("n"), tail.alias("last_ok"), F.max("seq").alias("end"))
    after = rows.join(F.broadcast(parts.select("_part", "last_ok")), "_part").groupBy("_part").agg(F.count_if(F.col("last_ok").isNull() | (F.col("seq") > F.col("last_ok"))).alias("trailing"), F.max("last_ok").isNotNull().alias("any_ok"))
    order = Window.orderBy("_part")
    after = after.withColumn("_run", F.sum(F.col("any_ok").cast("int")).over(order))
    after = after.withColumn("_sum", F.sum("trailing").over(Window.partitionBy("_run").orderBy("_part")))
    carried = after.select("_part", F.coalesce(F.lag("_sum").over(order), F.lit(0)).alias("_carried"))
    # rowsBetween keeps equal numbers apart.
    run = Window.partitionBy("_part", "_oks").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    failed = F.sum((~F.col("ok")).cast("int")).over(run)
    marked = rows.withColumn("_failures", failed).join(F.broadcast(carried), "_part")
    reached = F.col("_failures") + F.when(F.col("_oks") == 0, F.col("_carried")).otherwise(0) >= most
    stop = marked.where(reached & ~F.col("ok")).agg(F.min("seq").alias("_stop"))
    return results.join(F.broadcast(stop), F.lit(True)).where("_stop is null or seq <= _stop").drop("_stop")
