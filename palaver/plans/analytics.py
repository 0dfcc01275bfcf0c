"""Queries over embeddings, events and orders: vectors, ratings, selection, incremental work."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.functions import text as tx
from palaver.functions.hashing import bucket, shuffled
from palaver.functions.numbers import rounded
from palaver.operators import incremental, ratings, select, turns, vectors
from palaver.plans.conversations import HASH, labelled
from palaver.sources.tables import table
from palaver.streaming.suppress import batch_state


def _rounded(rows, n=6):
    return rows.select(*(rounded(c, n).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes))


def _embeddings(spark, d):
    return table(spark, d, "embeddings")


def _means(spark, d):
    return vectors.centroids(_embeddings(spark, d), "label", "embedding")


def centroids(spark, d):
    rows = _means(spark, d).select("label", F.posexplode("centroid").alias("i", "x"))
    return rows.select("label", "i", rounded("x", 6).alias("x"))


def pairs_within(spark, d):
    """One line per label: the operator's pairs are as many as the square of a group."""
    rows = vectors.pairs_within(_embeddings(spark, d), "label", "vec_id", "embedding")
    return _rounded(rows.groupBy("label").agg(F.count("*").alias("pairs"), F.avg("distance").alias("mean"), F.min("distance").alias("min"), F.max("distance").alias("max")))


def mean_within(spark, d):
    rows = vectors.mean_within(_embeddings(spark, d), "label", "embedding")
    return rows.select("label", "pairs", rounded(F.col("total") / F.col("pairs"), 6).alias("mean"))


def pairs_between(spark, d):
    return _rounded(vectors.pairs_between(_means(spark, d), "label"))


def nearest_neighbor(spark, d):
    return _rounded(vectors.nearest_neighbors(_means(spark, d), "label"))


def id_accuracy(spark, d):
    return _rounded(vectors.accuracy(vectors.identify(_embeddings(spark, d), _means(spark, d), "label", "vec_id", "embedding"), "label"))


def distance_summary(spark, d):
    return _rounded(vectors.pair_summary(_embeddings(spark, d), "label", "vec_id", "embedding"))


def separation_ratio(spark, d):
    return _rounded(vectors.separation_ratio(_embeddings(spark, d), "label", "embedding"))


def collision_count(spark, d):
    rows = _embeddings(spark, d)
    one, two = (vectors.nearest_neighbors(vectors.centroids(rows.where(F.col("vec_id") % 2 == k), "label", "embedding"), "label") for k in (0, 1))
    return _rounded(vectors.collisions(one, two, 0.25))


def channel_shift(spark, d):
    rows = _embeddings(spark, d)
    variants = rows.where("vec_id % 2 = 1").select(F.col("vec_id").alias("variant_id"), (F.col("vec_id") - 1).alias("original_id"), (F.col("vec_id") % 3).alias("perturbation"))
    return _rounded(vectors.channel_shift(variants, rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), vectors.pairs_between(_means(spark, d), "label")))


def confound_corr(spark, d):
    rows = _embeddings(spark, d).select("label", F.get("embedding", 0).cast("double").alias("feature"))
    means = vectors.group_features(rows, "label", ["feature"])
    return _rounded(vectors.confound(vectors.pairs_between(_means(spark, d), "label"), means, "label", "feature"))


def _ratings(spark, d):
    corpus = F.when(F.col("user_id") % 2 == 0, "proposed").otherwise("natural")
    return table(spark, d, "events").select(F.col("user_id").alias("participant"), F.col("event_type").alias("dimension"), corpus.alias("corpus"), F.col("value").alias("score"))


def rating_describe(spark, d):
    return _rounded(ratings.describe(_ratings(spark, d), "dimension", "corpus"))


def rating_pivot_diff(spark, d):
    return _rounded(ratings.pivot_difference(_ratings(spark, d), "dimension"))


def ratings_per_key(spark, d):
    return _rounded(ratings.per_key(_ratings(spark, d), "participant", "dimension"))


def holm_adjust(spark, d):
    tests = _ratings(spark, d).select("dimension").distinct().withColumn("p", bucket("p-v1", F.col("dimension")) / 20)
    return _rounded(ratings.holm(tests), 9)


def usage_concentration(spark, d):
    return _rounded(select.concentration(select.usage(table(spark, d, "lineitem"), "l_suppkey", "l_orderkey")), 9)


def rebalance_keep(spark, d):
    """Each supplier stands for a character, each order for a file."""
    return select.keep_within_cap(table(spark, d, "lineitem"), "l_suppkey", "l_orderkey", 50, "keep-v1")


def stable_order(spark, d):
    return table(spark, d, "orders").select("o_orderkey", shuffled("order-v1", F.col("o_orderkey").cast("string")).alias("order_key")).orderBy("order_key")


def round_robin_select(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return select.round_robin(rows, "o_orderpriority", "o_orderkey", 123, "pick-v1")


def needed_for_share(spark, d):
    rows = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("lang") == "es").alias("having"))
    return rows.withColumn("needed", select.needed_for_share(F.col("total"), F.col("having"), 0.3))


def subset_per_group(spark, d):
    return select.first_per_group(_embeddings(spark, d).select("label", "vec_id"), "label", "vec_id", 4, 7)


def first_owner(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.concat_ws("/", "p_brand", "p_type").alias("voice"))
    return select.first_owner(rows, "voice", "p_partkey")


def topk_checkpoints(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return select.best_per_group(rows, "o_custkey", "o_totalprice", "o_orderkey")


def resume_pending(spark, d):
    rows = labelled(spark, d).select("conv_id", "turn")
    done = rows.where(bucket("done-v1", F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))) < 0.4)
    return incremental.pending(rows, done, "conv_id", "turn")


def stale_set(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("hash"))
    old = docs.where("doc_id % 7 <> 0").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("hash")).when(F.col("doc_id") % 3 == 1, "other").alias("recorded_hash"), (F.col("doc_id") % 5 != 0).alias("has_output"))
    return incremental.cache_status(docs, old, "doc_id").select("doc_id", "status")


def manifest_upsert(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    new = rows.where("s_suppkey % 4 = 0").withColumn("s_acctbal", F.col("s_acctbal") + 1).union(rows.where("s_suppkey % 9 = 0").select(F.col("s_suppkey") + 1_000_000, "s_name", "s_acctbal"))
    return _rounded(incremental.upsert(rows, new, "s_suppkey"), 2)


def _versions(spark, d):
    n = F.col("p_partkey")
    version = F.concat_ws(".", (n % 2).cast("string"), (n % 3).cast("string"), (n % 5).cast("string"))
    return table(spark, d, "part").select(n, version.alias("version"))


def version_gate(spark, d):
    rows = _versions(spark, d).withColumn("version", F.when(F.col("p_partkey") % 7 == 0, "x").otherwise(F.col("version")))
    return rows.select("p_partkey", "version", tx.must_regenerate(F.col("version"), F.lit("1.2.0")).alias("regenerate"))


def regen_decision(spark, d):
    n, key = F.col("p_partkey"), F.col("p_partkey")
    rows = table(spark, d, "part")
    scenarios = rows.select(key, F.create_map(F.lit("a"), "p_brand", F.lit("b"), "p_type").alias("files"), F.col("p_name").alias("composite"))
    ledger = _versions(spark, d).join(rows, "p_partkey").where("p_partkey % 11 <> 0").select(
        key, F.lit(True).alias("tracked"), F.when(n % 13 != 0, F.when(n % 2 == 0, "1.2.9").otherwise(F.col("version"))).alias("code_version"),
        F.create_map(F.lit("a"), "p_brand", F.when(n % 4 == 0, "c").otherwise("b"), "p_type").alias("config_hash"), F.when(n % 6 == 0, "old").otherwise(F.col("p_name")).alias("composite_hash"))
    return incremental.regenerate(scenarios, ledger, "p_partkey", "1.2.0").select("p_partkey", "reason")


def config_changed_files(spark, d):
    rows = table(spark, d, "part").select(F.col("p_brand").alias("key"), F.col("p_partkey").alias("file"), F.md5(F.col("p_name").cast("binary")).alias("hash"))
    old = rows.where("file % 5 <> 0").withColumn("hash", F.when(F.col("file") % 3 == 0, "x").otherwise(F.col("hash")))
    return incremental.config_changes(rows.where("file % 7 <> 0"), old, "key", "file")


def dir_fingerprint(spark, d):
    rows = table(spark, d, "documents").select(F.concat_ws("/", "source", F.floor(F.col("doc_id") / 100).cast("string")).alias("folder"), "doc_id", F.sha2(F.col("text"), 256).alias("hash"))
    return incremental.fingerprint(rows, "folder", "doc_id", "hash")


def dedupe_ids(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.concat_ws("/", "p_brand", "p_type").alias("id"))
    return turns.disambiguate_ids(rows, "id", "p_partkey").select("p_partkey", "uid")


def config_resolve(spark, d):
    n = F.col("p_partkey")
    variant = F.when(n % 3 == 0, F.concat("p_name", F.lit("_long"))).when(n % 3 == 1, F.concat("p_name", F.lit("_12")))
    rows = table(spark, d, "part").select("p_partkey", variant.alias("variant"), F.when(n % 4 == 0, F.concat(F.col("p_brand"), F.lit("_long"))).otherwise(F.col("p_brand")).alias("stem"), "p_type")
    base = table(spark, d, "part").where("p_partkey % 5 = 0")
    named = base.groupBy(F.col("p_name").alias("config_key")).agg(F.min("p_partkey").alias("config"))
    brand = table(spark, d, "part").where("p_partkey % 97 = 0").groupBy(F.col("p_brand").alias("config_key")).agg(F.min("p_partkey").alias("config"))
    kind = base.groupBy(F.concat(F.lit("s/"), "p_type").alias("config_key")).agg(F.min("p_partkey").alias("config"))
    keys = incremental.fallback_keys(F.col("variant"), F.col("stem"), F.lit("s"), F.col("p_type"))
    return incremental.resolve(rows, named.union(brand).union(kind), "p_partkey", keys).select("p_partkey", "config", "priority")


def suppress_state(spark, d):
    """An error silences a user's session until the next signup."""
    events = table(spark, d, "events")
    rows = batch_state(events, "user_id", ("ts", "event_id"), F.col("event_type") == "error", F.col("event_type") == "signup")
    return rows.select("event_id", "suppressed")


QUERIES = {f.__name__: f for f in (
    centroids, pairs_within, mean_within, pairs_between, nearest_neighbor, id_accuracy, distance_summary, separation_ratio, collision_count, channel_shift, confound_corr,
    rating_describe, rating_pivot_diff, ratings_per_key, holm_adjust, usage_concentration, rebalance_keep, stable_order, round_robin_select, needed_for_share, subset_per_group,
    first_owner, topk_checkpoints, resume_pending, stale_set, manifest_upsert, version_gate, regen_decision, config_changed_files, dir_fingerprint, dedupe_ids, config_resolve, suppress_state,
)}


def _centroids(name="m", where="true"):
    return f"""{name}_p as (select label, i, avg(x) as x from (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings where {where}) group by all),
{name}_v as (select label, list(x order by i) as v from {name}_p group by 1),
{name} as (select label, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) as v from {name}_v)"""


_PAIRS = """pw as (select a.label, a.vec_id as va, b.vec_id as vb, 1 - list_inner_product(a.embedding::double[], b.embedding::double[]) as distance
from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id)"""
_BETWEEN = "pb as (select a.label as label_a, b.label as label_b, 1 - list_inner_product(a.v, b.v) as distance from m a join m b on a.label < b.label)"


def _nearest(name, m):
    return f"{name} as (select a.label, arg_min(b.label, struct_pack(x := 1 - list_inner_product(a.v, b.v), l := b.label)) as neighbor, min(1 - list_inner_product(a.v, b.v)) as distance from {m} a join {m} b on a.label <> b.label group by 1)"


def _summary(v):
    q = lambda p: f"round(quantile_cont({v}, {p}), 6)"
    return f"count({v}) as n, round(avg({v}), 6) as mean, round(stddev_pop({v}), 6) as std, {q(0.5)} as median, {q(0.05)} as p5, {q(0.95)} as p95"


_RATINGS = "r as (select user_id as participant, event_type as dimension, case when user_id % 2 = 0 then 'proposed' else 'natural' end as corpus, value as score from events)"
_LABELS = "l as (select conv_id, turn from conversations where role <> 'assistant')"
_VERSION = "(p_partkey % 2) || '.' || (p_partkey % 3) || '.' || (p_partkey % 5)"

ORACLE = {
    "centroids": f"with {_centroids()} select label, i::int - 1 as i, round(x, 6) as x from (select label, unnest(v) as x, generate_subscripts(v, 1) as i from m)",
    "pairs_within": f"with {_PAIRS} select label, count(*) as pairs, round(avg(distance), 6) as mean, round(min(distance), 6) as min, round(max(distance), 6) as max from pw group by 1",
    "mean_within": f"with {_PAIRS} select label, count(*) as pairs, round(avg(distance), 6) as mean from pw group by 1",
    "pairs_between": f"with {_centroids()}, {_BETWEEN} select label_a, label_b, round(distance, 6) as distance from pb",
    "nearest_neighbor": f"with {_centroids()}, {_nearest('n', 'm')} select label, neighbor, round(distance, 6) as distance from n",
    "id_accuracy": f"""with {_centroids()}, x as (select e.vec_id, e.label, arg_max(m.label, struct_pack(s := list_inner_product(e.embedding::double[], m.v), l := -m.label)) as predicted from embeddings e cross join m group by all)
select count(*) as n, count(*) filter (predicted = label) as correct, round(avg((predicted = label)::int), 6) as accuracy from x""",
    "distance_summary": f"with {_PAIRS} select label, {_summary('distance')} from pw group by 1",
    "separation_ratio": f"""with {_centroids()}, {_PAIRS}, {_BETWEEN}, w as (select avg(distance) as w from pw), b as (select avg(distance) as b from pb)
select round(w, 6) as within, round(b, 6) as between, round(b / w, 6) as ratio from w cross join b""",
    "collision_count": f"""with {_centroids('a', 'vec_id % 2 = 0')}, {_centroids('b', 'vec_id % 2 = 1')}, {_nearest('x', 'a')}, {_nearest('y', 'b')}, t as (select quantile_cont(distance, 0.25) as t from y)
select round(t, 6) as threshold, count(*) as n, count(*) filter (distance <= t) as collisions from x cross join t group by t""",
    "channel_shift": f"""with {_centroids()}, {_BETWEEN}, s as (select v.vec_id % 3 as perturbation, 1 - list_inner_product(v.embedding::double[], o.embedding::double[]) as shift from embeddings v join embeddings o on o.vec_id = v.vec_id - 1 where v.vec_id % 2 = 1)
select perturbation, {_summary('shift')}, avg(shift) < (select avg(distance) from pb) as below_baseline from s group by 1""",
    "confound_corr": f"""with {_centroids()}, {_BETWEEN}, f as (select label, avg(embedding[1]::double) as f from embeddings group by 1)
select count(*) as n, round(corr(distance, abs(x.f - y.f)), 6) as r from pb join f x on x.label = label_a join f y on y.label = label_b""",
    "rating_describe": f"with {_RATINGS} select dimension, corpus, count(score) as n, round(avg(score), 6) as mean, round(stddev_samp(score), 6) as std, round(median(score), 6) as median, round(min(score), 6) as min, round(max(score), 6) as max from r group by all",
    "rating_pivot_diff": f"""with {_RATINGS}, p as (select dimension, avg(score) filter (corpus = 'natural') as n, avg(score) filter (corpus = 'proposed') as p from r group by 1)
select dimension, round(n, 6) as natural, round(p, 6) as proposed, round(p - n, 6) as difference from p""",
    "ratings_per_key": f"""with {_RATINGS}, s as (select count(*) as size from r group by participant, dimension)
select count(*) as count, round(avg(size), 6) as mean, round(stddev_samp(size), 6) as std, min(size) as min, max(size) as max, quantile_cont(size::double, 0.25) as q25, quantile_cont(size::double, 0.5) as q50, quantile_cont(size::double, 0.75) as q75 from s""",
    "holm_adjust": f"""with t as (select distinct event_type as dimension from events), p as (select dimension, {HASH.format(seed='p-v1', key='dimension')} / 20 as p from t),
s as (select *, (count(*) over () - row_number() over (order by p) + 1) * p as step from p)
select dimension, round(p, 9) as p, round(least(1.0::double, max(step) over (order by p rows unbounded preceding)), 9) as p_adjusted, least(1.0::double, max(step) over (order by p rows unbounded preceding)) <= 0.05 as rejected from s""",
    "usage_concentration": """with u as (select l_suppkey, count(distinct l_orderkey) as f from lineitem group by 1), k as (select *, row_number() over (order by f desc) as r from u)
select count(*) as characters, sum(f)::bigint as total, round(sum(f) filter (r <= 5) / sum(f), 9) as top5_share, round(sum(f) filter (r <= 20) / sum(f), 9) as top20_share from k""",
    "rebalance_keep": """with o as (select distinct l_suppkey, l_orderkey from lineitem), k as (select *, row_number() over (partition by l_suppkey order by sha1('keep-v1:' || l_orderkey), l_orderkey) as rank from o)
select l_suppkey, l_orderkey, rank from k where rank <= 50""",
    "stable_order": "select o_orderkey, sha1('order-v1:' || o_orderkey) as order_key from orders",
    "round_robin_select": """with k as (select o_orderkey, o_orderpriority, row_number() over (partition by o_orderpriority order by sha1('pick-v1:' || o_orderkey), o_orderkey) as rank from orders)
select * from k order by rank, o_orderpriority limit 123""",
    "needed_for_share": """select source, count(*) as total, count(*) filter (lang = 'es') as having,
greatest(0, round_even((0.3::double * count(*) - count(*) filter (lang = 'es')) / (1 - 0.3::double), 0))::bigint as needed from documents group by 1""",
    "subset_per_group": """with l as (select distinct label from embeddings order by 1 limit 4), k as (select label, vec_id, row_number() over (partition by label order by vec_id) as rank from embeddings semi join l using (label))
select * from k where rank <= 7""",
    "first_owner": """with v as (select p_partkey, p_brand || '/' || p_type as voice from part)
select voice, p_partkey, min(p_partkey) over (partition by voice) as first_owner, p_partkey = min(p_partkey) over (partition by voice) as is_owner from v""",
    "topk_checkpoints": """with k as (select o_custkey, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders)
select * from k where rank <= 3""",
    "resume_pending": f"with {_LABELS} select conv_id, turn from l where {HASH.format(seed='done-v1', key=chr(40) + 'conv_id || ' + chr(39) + '/' + chr(39) + ' || turn' + chr(41))} >= 0.4",
    "stale_set": """select doc_id, case when doc_id % 7 = 0 or doc_id % 5 = 0 then 'new' when doc_id % 3 = 1 then 'stale' else 'cached' end as status from documents""",
    "manifest_upsert": """select s_suppkey, s_name, round(case when s_suppkey % 4 = 0 then s_acctbal + 1 else s_acctbal end, 2) as s_acctbal from supplier
union all select s_suppkey + 1000000, s_name, round(s_acctbal, 2) from supplier where s_suppkey % 9 = 0""",
    "version_gate": f"""with v as (select p_partkey, case when p_partkey % 7 = 0 then 'x' else {_VERSION} end as version from part)
select p_partkey, version, version = 'x' or version not like '1.2.%' as regenerate from v""",
    "regen_decision": f"""with v as (select *, case when p_partkey % 13 <> 0 then case when p_partkey % 2 = 0 then '1.2.9' else {_VERSION} end end as cv from part)
select p_partkey, case when p_partkey % 11 = 0 then 'untracked' when cv is null then 'no code version' when cv not like '1.2.%' then 'code version'
  when p_partkey % 4 = 0 then 'config: b,c' when p_partkey % 6 = 0 then 'hash' end as reason from v""",
    "config_changed_files": """with n as (select p_brand as key, p_partkey as file, md5(p_name) as hash from part where p_partkey % 7 <> 0), o as (select p_brand as key, p_partkey as file, case when p_partkey % 3 = 0 then 'x' else md5(p_name) end as hash from part where p_partkey % 5 <> 0)
select key, file, case when o.hash is null then 'added' when n.hash is null then 'removed' else 'changed' end as change from n full join o using (key, file) where n.hash is distinct from o.hash""",
    "dir_fingerprint": """with f as (select source || '/' || (doc_id // 100) as folder, doc_id || ':' || sha256(text) as line from documents)
select folder, count(*) as files, sha256(string_agg(line, chr(10) order by line)) as fingerprint from f group by 1""",
    "dedupe_ids": """with n as (select p_partkey, p_brand || '/' || p_type as id, row_number() over (partition by p_brand, p_type order by p_partkey) - 1 as n from part)
select p_partkey, case when n = 0 then id else id || '#' || n end as uid from n""",
    "config_resolve": """with b as (select * from part where p_partkey % 5 = 0), i as (select p_name as k, min(p_partkey) as config from b group by 1
  union all select p_brand, min(p_partkey) from part where p_partkey % 97 = 0 group by 1 union all select 's/' || p_type, min(p_partkey) from b group by 1),
c as (select p_partkey, unnest([{'p': 0, 'k': case p_partkey % 3 when 0 then p_name || '_long' when 1 then p_name || '_12' end}, {'p': 1, 'k': case when p_partkey % 4 = 0 then p_brand || '_long' else p_brand end},
  {'p': 2, 'k': case p_partkey % 3 when 0 then p_name end}, {'p': 3, 'k': case p_partkey % 3 when 1 then p_name end}, {'p': 4, 'k': case when p_partkey % 4 = 0 then p_brand end}, {'p': 6, 'k': 's/' || p_type}]) as x from part),
f as (select p_partkey, min(x.p) as priority, arg_min(config, x.p) as config from c join i on x.k = i.k group by 1)
select p_partkey, config, priority from part left join f using (p_partkey)""",
    "suppress_state": """with f as (select event_id, user_id, ts, case event_type when 'error' then true when 'signup' then false end as flag from events)
select event_id, coalesce(last_value(flag ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), false) as suppressed from f""",
}
