"""Embedding analytics: centroids, pair distances, neighbours, identification, correlation.

Vectors are arrays of unit norm; arithmetic is in double precision. Distances are 1 - dot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Centroids of one array.
MAX_CENTROIDS = 2000
#: Rows of one side of a pair of blocks, and ranges of distance that are counted before percentiles.
BLOCK, BINS = 1024, 32768


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    return F.transform(v, lambda x: x / norm(v))


def distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b)


def join_vectors(index: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Rows of the index that have a vector; the others are left out."""
    return index.join(vectors, key)


def dropped_vectors(index: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    return index.join(vectors.select(key), key, "left_anti").agg(F.count("*").alias("dropped"))


def centroids(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """Unit mean of each group. Elements are averaged map-side, so a large group is no hot task."""
    parts = rows.select(group, F.posexplode(as_double(F.col(vector))).alias("i", "x")).groupBy(group, "i").agg(F.avg("x").alias("m"))
    whole = parts.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("centroid"))
    return whole.withColumn("centroid", unit(F.col("centroid")))


def _tree(terms: list) -> Column:
    """Sum of the terms, pair by pair."""
    while len(terms) > 1:
        terms = [a + b for a, b in zip(terms[::2], terms[1::2])] + terms[len(terms) // 2 * 2 :]
    return terms[0] if terms else F.lit(0.0)


def pairs_within(rows: DataFrame, group: str, key: str, vector: str, block: int = BLOCK) -> DataFrame:
    """Distance of every pair of one group; as many rows as pairs, by the operator's meaning.

    Groups are dealt to blocks of about `block` rows, and pairs of blocks are joined, so that a large
    group is many tasks. Elements become columns for the join: compiled code multiplies them some
    hundred times faster than higher-order functions do. Distances of a vector that is null, or holds
    nulls, and those of vectors of different sizes are null.
    """
    spark = rows.sparkSession
    rows = rows.select(group, key, vector).where(F.col(group).isNotNull() & F.col(key).isNotNull())
    d = rows.agg(F.max(F.size(vector))).head()[0] or 0
    most = "spark.sql.codegen.maxFields"  # both sides' columns are fields of the join
    spark.conf.set(most, str(max(int(spark.conf.get(most, "100")), 2 * d + 20)))
    # a number that the adaptive planner keeps: it would size tasks by bytes, which are few here, not by pairs
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    large = rows.groupBy(group).count().where(F.col("count") > block)  # one row for each `block` rows at most
    many = large.select(group, F.ceil(F.col("count") / block).cast("int").alias("_of"))
    dealt = rows.join(F.broadcast(many), group, "left").withColumn("_of", F.coalesce("_of", F.lit(1)))
    dealt = dealt.withColumn("_at", F.pmod(F.xxhash64(key), F.col("_of")).cast("int"))

    def side(s: str, i: Column, j: Column) -> DataFrame:
        met = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_at")) if s == "b" else F.sequence("_at", F.col("_of") - 1)))
        met = met.select(group, i.alias("_i"), j.alias("_j"), F.col(key).alias(f"_k{s}"), F.col(vector).alias("_v")).repartition(tasks, group, "_i", "_j")
        size = F.when(~F.exists("_v", lambda x: x.isNull()), F.size("_v"))
        return met.select(group, "_i", "_j", f"_k{s}", size.alias(f"_n{s}"), *(F.coalesce(F.get("_v", F.lit(n)).cast("double"), F.lit(0.0)).alias(f"_{s}{n}") for n in range(d)))

    a, b = side("a", F.col("_at"), F.col("_other")), side("b", F.col("_other"), F.col("_at"))
    out = a.join(b.hint("shuffle_hash"), [group, "_i", "_j"]).where((F.col("_i") < F.col("_j")) | (F.col("_ka") < F.col("_kb")))
    apart = 1 - _tree([F.col(f"_a{n}") * F.col(f"_b{n}") for n in range(d)])
    low, high = F.least("_ka", "_kb"), F.greatest("_ka", "_kb")
    return out.select(group, low.alias(f"{key}_a"), high.alias(f"{key}_b"), F.when(F.col("_na") == F.col("_nb"), apart).alias("distance"))


def pair_summary(rows: DataFrame, group: str, key: str, vector: str, bins: int = BINS) -> DataFrame:
    """summary() of the distances of pairs_within(), for groups of any size.

    The first pass over the pairs counts them in ranges of distance. A second keeps only values in the
    ranges that hold a percentile, so that no task gathers a group. Percentiles are exact.
    """
    v = as_double(F.col(vector))
    reach = rows.select(dot(v, v).alias("q")).where(F.col("q") < float("inf")).agg(F.max("q")).head()[0] or 1.0
    wide = 2.0 * reach / bins
    d = F.when(~F.isnan("distance"), F.col("distance"))
    pairs = pairs_within(rows, group, key, vector).select(group, d.alias("d")).withColumn("bin", F.floor(F.col("d") * (1 / wide)))
    rest = F.col("d") - F.col("bin") * wide
    first = pairs.groupBy(group, "bin").agg(F.count("d").alias("c"), F.sum(rest).alias("s"), F.sum(rest * rest).alias("q"))
    whole, upto = Window.partitionBy(group), Window.partitionBy(group).orderBy("bin")
    mid = F.col("bin") * wide + F.col("s") / F.col("c")
    first = first.withColumns({"mid": mid, "n": F.sum("c").over(whole), "before": F.sum("c").over(upto) - F.col("c")})
    first = first.withColumn("mean", F.sum(F.col("mid") * F.col("c")).over(whole) / F.nullif("n", F.lit(0)))
    at = [(F.col("n") - 1) * p for p in (0.05, 0.5, 0.95)]
    ranks = [f(x) for x in at for f in (F.floor, F.ceil)]
    here = lambda k: (ranks[k] >= F.col("before")) & (ranks[k] < F.col("before") + F.col("c"))
    spread = F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("c") + F.col("c") * (F.col("mid") - F.col("mean")) * (F.col("mid") - F.col("mean")))
    stats = first.groupBy(group).agg(F.max("n").alias("n"), F.max("mean").alias("mean"), spread.alias("m2"), *(F.max(F.when(here(k), F.struct("bin", "before"))).alias(f"r{k}") for k in range(6)))
    # one value that stays whole: both readers then share the first pass
    stats = stats.groupBy(group).agg(F.max(F.struct("n", "mean", "m2", *(f"r{k}" for k in range(6)))).alias("x"))

    wanted = stats.select(group, *(F.col(f"x.r{k}.bin").alias(f"b{k}") for k in range(6)))
    near = pairs.join(F.broadcast(wanted), group).where(F.col("bin").isin(*(F.col(f"b{k}") for k in range(6))))
    second = near.groupBy(group, "bin", "d").agg(F.count("*").alias("c"))
    second = second.withColumn("before", F.sum("c").over(Window.partitionBy(group, "bin").orderBy("d")) - F.col("c"))
    second = second.join(F.broadcast(stats), group).select(group, "bin", "d", "c", "before", F.col("x.n").alias("n"), *(F.col(f"x.r{k}").alias(f"r{k}") for k in range(6)))
    local = lambda k: ranks[k] - F.col(f"r{k}.before")
    found = lambda k: (F.col("bin") == F.col(f"r{k}.bin")) & (local(k) >= F.col("before")) & (local(k) < F.col("before") + F.col("c"))
    values = second.groupBy(group).agg(*(F.max(F.when(found(k), F.col("d"))).alias(f"v{k}") for k in range(6)))

    out = stats.select(group, "x.n", "x.mean", "x.m2").join(values, group, "left")
    q = [F.col(f"v{2 * k}") + (at[k] - F.floor(at[k])) * (F.col(f"v{2 * k + 1}") - F.col(f"v{2 * k}")) for k in range(3)]
    std = F.sqrt(F.greatest(F.col("m2"), F.lit(0.0)) / F.nullif("n", F.lit(0)))
    return out.select(group, "n", "mean", std.alias("std"), q[1].alias("median"), q[0].alias("p5"), q[2].alias("p95"))


def mean_within(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """Pairs and summed distance within each group without making the pairs.

    The dot products of all pairs add up to half of |sum|^2 - sum |v|^2.
    """
    v = as_double(F.col(vector))
    sums = rows.select(group, F.posexplode(v).alias("i", "x")).groupBy(group, "i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    out = sums.groupBy(group).agg(F.sum(F.col("s") * F.col("s") - F.col("q")).alias("twice"), F.max("n").alias("n"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return out.select(group, "n", pairs.cast("long").alias("pairs"), (pairs - F.col("twice") / 2).alias("total"))


def pairs_between(means: DataFrame, group: str) -> DataFrame:
    """Distance of every pair of centroids; their number is that of the groups, so one side is broadcast when small."""
    side = lambda s: means.select(F.col(group).alias(f"{group}_{s}"), F.col("centroid").alias(f"c_{s}"))
    out = side("a").join(side("b"), F.col(f"{group}_a") < F.col(f"{group}_b"))
    return out.select(f"{group}_a", f"{group}_b", distance(F.col("c_a"), F.col("c_b")).alias("distance"))


def nearest_neighbors(means: DataFrame, group: str) -> DataFrame:
    """The nearest other centroid of each; of equals the first."""
    other = means.select(F.col(group).alias("neighbor"), F.col("centroid").alias("c"))
    out = means.join(other, F.col(group) != F.col("neighbor")).withColumn("distance", distance(F.col("centroid"), F.col("c")))
    best = out.groupBy(group).agg(F.min(F.struct("distance", "neighbor")).alias("m"))
    return best.select(group, "m.neighbor", "m.distance")


def identify(rows: DataFrame, means: DataFrame, group: str, key: str, vector: str, block: int = MAX_CENTROIDS) -> DataFrame:
    """predicted: the group of the most similar centroid, of equals the first.

    Centroids are compared in arrays of `block`. One array is broadcast; more of them are dealt to
    the rows, and a row keeps the best of each array before its results meet in one shuffle.
    """
    count = means.count()
    rank = F.row_number().over(Window.orderBy(group)) - 1 if count <= block else F.xxhash64(group)
    blocks = max(1, -(-count // block))
    table = means.withColumn("_b", F.pmod(rank, F.lit(blocks)).cast("int")).groupBy("_b").agg(F.array_sort(F.collect_list(F.struct(group, "centroid"))).alias("means"))
    v = as_double(F.col(vector))
    best = F.aggregate(
        F.transform("means", lambda m: F.struct(m[group].alias("g"), dot(v, m["centroid"]).alias("s"))),
        F.struct(F.lit(None).cast(rows.schema[group].dataType).alias("g"), F.lit(float("-inf")).alias("s")),
        lambda acc, m: F.when(m["s"] > acc["s"], m).otherwise(acc),
    )
    if blocks == 1:
        return rows.join(F.broadcast(table), F.lit(True)).select(key, group, best["g"].alias("predicted"))
    dealt = rows.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(table, "_b").select(key, group, best.alias("x"))
    top = dealt.groupBy(key, group).agg(F.max(F.col("x.s")).alias("_s"), F.collect_list("x").alias("_x"))
    return top.select(key, group, F.array_min(F.transform(F.filter("_x", lambda x: x["s"] == F.col("_s")), lambda x: x["g"])).alias("predicted"))


def accuracy(predicted: DataFrame, group: str) -> DataFrame:
    hit = F.col("predicted") == F.col(group)
    return predicted.agg(F.count("*").alias("n"), F.count_if(hit).alias("correct"), F.avg(hit.cast("double")).alias("accuracy"))


def summary(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """n, mean, population deviation, median, 5th and 95th percentile; NaN is left out."""
    v = F.when(~F.isnan(value), F.col(value))
    out = rows.groupBy(*by) if by else rows
    q = F.percentile(v, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    out = out.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), q.alias("q"))
    return out.withColumns({"median": F.get("q", 1), "p5": F.get("q", 0), "p95": F.get("q", 2)}).drop("q")


def system_table(rows: DataFrame, system: str, group: str, vector: str) -> DataFrame:
    """Per system: groups, utterances, and mean distance within groups and between their centroids."""
    both = F.struct(system, group)
    keyed = rows.withColumn("_group", both)
    within = mean_within(keyed, "_group", vector).groupBy(F.col(f"_group.{system}").alias(system)).agg(F.count("*").alias("groups"), F.sum("n").alias("utterances"), F.try_divide(F.sum("total"), F.sum("pairs")).alias("within"))
    means = centroids(keyed, "_group", vector).select(F.col(f"_group.{system}").alias(system), F.col(f"_group.{group}").alias("g"), "centroid")
    pairs = means.alias("a").join(means.alias("b"), (F.col(f"a.{system}") == F.col(f"b.{system}")) & (F.col("a.g") < F.col("b.g")))
    between = pairs.groupBy(F.col(f"a.{system}").alias(system)).agg(F.avg(distance(F.col("a.centroid"), F.col("b.centroid"))).alias("between"))
    return within.join(between, system, "left").withColumn("ratio", F.try_divide("between", F.nullif("within", F.lit(0.0))))


def separation_ratio(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean distance between centroids over mean distance within groups; null if either is missing or 0."""
    within = mean_within(rows, group, vector).agg((F.sum("total") / F.nullif(F.sum("pairs"), F.lit(0))).alias("within"))
    between = pairs_between(centroids(rows, group, vector), group).agg(F.avg("distance").alias("between"))
    return within.join(F.broadcast(between), F.lit(True)).withColumn("ratio", F.try_divide("between", F.nullif("within", F.lit(0.0))))


def collisions(neighbors: DataFrame, reference: DataFrame, quantile: float = 0.05) -> DataFrame:
    """How many neighbour distances are at most the reference's quantile."""
    limit = reference.agg(F.percentile("distance", F.lit(quantile)).alias("threshold"))
    return neighbors.join(F.broadcast(limit), F.lit(True)).groupBy("threshold").agg(F.count("*").alias("n"), F.count_if(F.col("distance") <= F.col("threshold")).alias("collisions"))


def channel_shift(variants: DataFrame, vectors: DataFrame, between: DataFrame) -> DataFrame:
    """Per perturbation: how far variants are from their originals, and whether nearer than groups are to each other.

    variants: variant_id, original_id, perturbation; vectors: id, vector; between: pair distances.
    """
    v = vectors.select(F.col("id").alias("variant_id"), as_double(F.col("vector")).alias("v"))
    o = vectors.select(F.col("id").alias("original_id"), as_double(F.col("vector")).alias("o"))
    moved = variants.join(v, "variant_id").join(o, "original_id").select("perturbation", distance(F.col("v"), F.col("o")).alias("shift"))
    base = between.agg(F.avg("distance").alias("baseline"))
    out = summary(moved, "shift", "perturbation").join(F.broadcast(base), F.lit(True))
    return out.withColumn("below_baseline", F.col("mean") < F.col("baseline")).drop("baseline")


def retained(before: Column, after: Column) -> Column:
    return F.try_divide(after, F.nullif(before, F.lit(0.0)))


def confound(pairs: DataFrame, means: DataFrame, group: str, feature: str) -> DataFrame:
    """Correlation of pair distances with differences of the groups' mean feature; null where one is constant."""
    m = lambda s: means.select(F.col(group).alias(f"{group}_{s}"), F.col(feature).alias(f"f_{s}"))
    rows = pairs.join(m("a"), f"{group}_a").join(m("b"), f"{group}_b").withColumn("difference", F.abs(F.col("f_a") - F.col("f_b")))
    r = F.when((F.stddev_pop("difference") > 0) & (F.stddev_pop("distance") > 0), F.corr("distance", "difference"))
    return rows.agg(F.count("*").alias("n"), r.alias("r"))


def group_features(rows: DataFrame, group: str, features) -> DataFrame:
    """Mean and sample deviation of each feature, NaN left out."""
    v = lambda f: F.nanvl(F.col(f), F.lit(None).cast("double"))
    return rows.groupBy(group).agg(*(a for f in features for a in (F.avg(v(f)).alias(f), F.stddev_samp(v(f)).alias(f"{f}_std"))))


def mean_max_pool(frames: Column) -> Column:
    """Element-wise mean, then maximum, of an array of vectors."""
    n, d = F.size(frames), F.size(F.get(frames, 0))
    at = lambda i: F.transform(frames, lambda f: F.get(f, i))
    mean = F.transform(F.sequence(F.lit(0), d - 1), lambda i: F.aggregate(at(i), F.lit(0.0), lambda a, x: a + x) / n)
    return F.concat(mean, F.transform(F.sequence(F.lit(0), d - 1), lambda i: F.array_max(at(i))))


def attention_pool(frames: Column, scores: Column) -> Column:
    """Mean of an array of vectors weighted by the softmax of their scores."""
    top = F.array_max(scores)
    weight = F.transform(scores, lambda s: F.exp(s - top))
    total = F.aggregate(weight, F.lit(0.0), lambda a, x: a + x)
    d = F.size(F.get(frames, 0))
    column = lambda i: F.aggregate(F.zip_with(frames, weight, lambda f, w: F.get(f, i) * w), F.lit(0.0), lambda a, x: a + x) / total
    return F.transform(F.sequence(F.lit(0), d - 1), column)
