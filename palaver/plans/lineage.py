"""Queries over times, scores, ledgers, selection and the release.

Conversations, parts and documents stand for turns, scenarios and files; what they lack is made
from their keys, in the same way in both engines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.functions.hashing import assign, bucket, joined_hash
from palaver.functions.numbers import rounded
from palaver.operators import detect, incremental, quality, release, scenario, select, turns, vectors
from palaver.plans.conversations import _TIMED, HASH, conversations, scored, timed
from palaver.plans.conversations import _scored as scored_sql
from palaver.sources import tables

VERSION = "1.2.0"


def _parts(spark, d):
    return tables.table(spark, d, "part")


def first_interaction(spark, d):
    return turns.first_interaction(conversations(spark, d)).select("conv_id", "turn", "first_interaction")


def planned_turn_times(spark, d):
    return scenario.planned_times(conversations(spark, d), "plan-v1")


def sampled_gaps(spark, d):
    rows = conversations(spark, d).withColumn("interjection", F.when(F.col("turn") % 5 == 2, "cut_in"))
    out = scenario.gaps(rows, "gaps-v1", {"cut_in": (0.5, 1.5)}, F.col("conv_id") % 2 == 0)
    return out.select("conv_id", "turn", rounded("gap", 6).alias("gap"))


def pause_statistics(spark, d):
    out = turns.pause_statistics(turns.turn_spans(timed(spark, d)).withColumn("gap", rounded(F.col("end") - F.col("start"), 3)))
    return out.select("n", rounded("total", 3).alias("total"), "least", "most")


def starts_filled(spark, d):
    missing = (F.col("conv_id") + F.col("turn")) % 3 != 0
    start = F.when(missing, rounded(F.pmod(F.col("turn") * 7 + F.col("conv_id"), F.lit(20)).cast("double"), 2))
    rows = conversations(spark, d).select("conv_id", F.struct("turn", start.alias("start")).alias("t"))
    rows = rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["start"]).alias("starts"))
    filled = turns.fill_starts(F.col("starts"), F.lit(16.0))
    return rows.select("conv_id", F.posexplode(filled).alias("i", "start"))


def early_stop(spark, d):
    rows = tables.table(spark, d, "events").select(F.col("event_id").alias("seq"), (~F.col("event_type").isin("error", "click")).alias("ok"))
    return detect.early_stop(rows, 4).agg(F.count("*").alias("n"), F.max("seq").alias("last"))


def score_distribution(spark, d):
    out = detect.score_distribution(scored(spark, d))
    return out.select(*(rounded(c, 9).alias(c) for c in out.columns))


def losses(spark, d):
    logit, label = F.col("score") * 8 - 4, F.col("expected").cast("double")
    return scored(spark, d).select("conv_id", "turn", rounded(detect.sigmoid(logit), 6).alias("p"), (detect.sigmoid(logit) > 0.5).alias("fires"), rounded(detect.weighted_loss(logit, label, 3.0, 0.1), 6).alias("loss"))


def learning_rates(spark, d):
    step = F.col("event_id")
    return tables.table(spark, d, "events").where("event_id < 500").select(step.alias("step"), rounded(detect.learning_rate(step, 50, 400, 0.001), 9).alias("rate"))


def pooled_vectors(spark, d):
    v = vectors.as_double(F.col("embedding"))
    frames = F.array(v, F.transform(v, lambda x: x * -0.5), F.reverse(v))
    scores = F.array(F.lit(0.5), (F.col("vec_id") % 3).cast("double"), F.lit(-1.0))
    attention, both = vectors.attention_pool(frames, scores), vectors.mean_max_pool(frames)
    rows = tables.table(spark, d, "embeddings").select("vec_id", attention.alias("a"), both.alias("m"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + F.abs(x))
    return rows.select("vec_id", rounded(total("a"), 5).alias("attention"), rounded(F.get("a", 0), 6).alias("first"), F.size("m").alias("size"), rounded(total("m"), 5).alias("mean_max"))


def config_hashes(spark, d):
    files = F.create_map(F.lit("b.json"), F.md5(F.col("p_name").cast("binary")), F.lit("a.json"), F.md5(F.col("p_type").cast("binary")))
    return _parts(spark, d).select("p_partkey", incremental.composite_hash(files).alias("composite"), joined_hash(F.col("p_brand"), F.col("p_name")).alias("joined"))


def referenced_characters(spark, d):
    rows = _parts(spark, d).select(
        F.col("p_partkey").alias("config"), F.when(F.col("p_size") % 3 != 0, F.array(F.concat(F.lit("stories/"), F.substring_index("p_name", " ", 1), F.lit(".txt")))).alias("backstory_files"),
        F.when(F.col("p_size") % 4 != 0, F.array(F.substring_index("p_name", " ", -1))).alias("characters"))
    have = _parts(spark, d).where("p_size > 5").select(F.substring_index("p_name", " ", -1).alias("character")).union(_parts(spark, d).where("p_size < 3").select(F.substring_index("p_name", " ", 1))).distinct()
    return scenario.referenced(rows, have)


_SPEECH = (
    "p_partkey", "p_partkey % 7 <> 0 as has_output", "case when p_partkey % 5 <> 0 then concat('1.', p_partkey % 3, '.', p_size) end as code_version", "md5(p_name) as speech_hash",
    "case p_partkey % 11 when 0 then null when 1 then md5(p_type) else md5(p_name) end as recorded_hash", "md5(p_brand) as background_hash", "case p_partkey % 4 when 0 then null when 1 then md5(p_name) else md5(p_brand) end as recorded_background")


def speech_staleness(spark, d):
    return incremental.speech_staleness(_parts(spark, d).selectExpr(*_SPEECH), VERSION).select("p_partkey", "redo")


def usable_utterances(spark, d):
    rows = tables.table(spark, d, "lineitem").selectExpr("l_orderkey", "case when l_linenumber = 7 then null when l_partkey % 9 = 0 then 44100 else 24000 end as rate", "l_orderkey % 5 + 1 as expected")
    return incremental.usable(rows, "l_orderkey", "expected")


def outputs_missing(spark, d):
    wanted = _parts(spark, d).select(F.concat(F.translate("p_name", " ", "_"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 3 == 0, "_long").otherwise("")).alias("key"), "p_partkey")
    done = wanted.where("p_partkey % 4 = 0").select("key")
    return tables.only_missing(wanted, done, "key", skip_long=True)


_LEDGER_KEY = "case p_partkey % 9 when 0 then concat(p_brand, '/', p_partkey) else concat(p_brand, '/couple/', p_partkey) end"


def stale_listing(spark, d):
    parts = _parts(spark, d)
    files = lambda k: F.create_map(F.lit("c.json"), F.md5(F.when(F.col("p_partkey") % 6 == k, F.col("p_type")).otherwise(F.col("p_name")).cast("binary")))
    ledger = parts.selectExpr(f"{_LEDGER_KEY} as key", "case when p_partkey % 5 <> 0 then concat('1.', p_partkey % 3, '.0') end as code_version", "p_partkey", "p_name", "p_type")
    ledger = ledger.select("key", "code_version", files(1).alias("config_hash"), F.lit("h").alias("composite_hash"), F.lit(True).alias("tracked"))
    current = parts.where("p_partkey % 8 <> 0").select(F.expr(_LEDGER_KEY).alias("key"), files(-1).alias("files"), F.when(F.col("p_partkey") % 7 == 0, "g").otherwise("h").alias("composite"))
    stale, malformed = incremental.stale_listing(ledger, current, "key", VERSION)
    return stale.select("key", "reason").union(malformed.select("key", F.lit("malformed key")))


def usage_caps(spark, d):
    used = select.usage(tables.table(spark, d, "lineitem"), "l_suppkey", "l_orderkey")
    return used.select("l_suppkey", "files", select.cap(0.15, F.col("files")).alias("cap"))


def share_projection(spark, d):
    out = select.share_report(tables.table(spark, d, "documents"), F.col("lang") == "de", F.lit(40))
    return out.select("n", "having", rounded("share", 9).alias("share"), rounded("after", 9).alias("after"))


def scenario_union(spark, d):
    docs = tables.table(spark, d, "documents").select(F.concat_ws("/", "source", "lang").alias("scenario"), "doc_id")
    return quality.scenario_status(docs.where("doc_id % 3 = 0"), docs.where("doc_id % 5 = 0"), "scenario")


def scenario_metrics(spark, d):
    """Coverage, quality and distribution of every scenario, generated or only expected, from one scan."""
    docs = tables.table(spark, d, "documents").select(F.concat_ws("/", "source", "lang").alias("scenario"), "doc_id", "n_chars")
    rows = quality.scenario_metrics(docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 4 = 0"), "scenario", "n_chars")
    return rows.select("scenario", "is_generated", *(rounded(c, 6).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes[2:]))


_RAW = "case (conv_id + turn) % 5 when 0 then '{\"speaker\": \"a\"}' when 1 then '{\"content\": null, \"speaker\": \"b\"}' when 2 then '{}' else '{\"speaker\": \"a\", \"content\": \"c\"}' end"


def missing_fields(spark, d):
    rows = conversations(spark, d).select("conv_id", "turn", F.expr(_RAW).alias("json"))
    return quality.missing_fields(rows).select("conv_id", "turn", "severity", "type", "message")


def missing_speakers(spark, d):
    role = F.when(F.col("turn") % 4 == 1, "  ").when(F.col("turn") % 4 != 2, F.col("role"))
    return quality.missing_speakers(conversations(spark, d).withColumn("role", role)).select("conv_id", "turn")


def single_speakers(spark, d):
    rows = conversations(spark, d).withColumn("role", F.when(F.col("conv_id") % 6 == 0, "user").otherwise(F.col("role")))
    return quality.single_speaker(rows, F.col("conv_id") % 2 == 0)


def errors_by_type(spark, d):
    rows = quality.errors_by_type(quality.all_errors(conversations(spark, d), "that", ("thst", "ly", "er")))
    return rows.select("type", "errors", "place")


def wanted_rows(spark, d):
    rows = _parts(spark, d).select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("category"), (F.col("p_size") > 20).alias("has_va"))
    return tables.wanted_rows(rows, category="Brand#2", has_va=True, limit=20).union(tables.wanted_rows(rows, ids=["3", "17", "x"]))


_CLIPS = ("l_suppkey as speaker", "l_partkey % 40 as text_id", "l_orderkey * 10 + l_linenumber as position", "l_linenumber % 2 + 1 as mic", "l_quantity as duration")


def speaker_texts(spark, d):
    rows = tables.table(spark, d, "lineitem").selectExpr(*_CLIPS).groupBy("speaker", "position").agg(F.min("text_id").alias("text_id"), F.min("mic").alias("mic"))
    rows = rows.withColumn("path", F.concat(F.lit("f_mic"), F.col("mic").cast("string"), F.lit(".flac")))
    return tables.first_texts(rows, 10, 5).select("speaker", "text_id", "position")


def speaker_clips(spark, d):
    rows = tables.table(spark, d, "lineitem").selectExpr(*_CLIPS).groupBy("speaker", "position").agg(F.min("duration").alias("duration"))
    return tables.first_clip(rows.withColumn("position", F.col("position") * 1000 + F.col("speaker")), 15, 10.0, 12.0)


def manifest_pairs(spark, d):
    rows = _parts(spark, d).select("p_partkey", F.split("p_name", " ").alias("paths"), F.split("p_type", " ").alias("texts"), "p_size")
    rows = rows.withColumn("texts", F.when(F.col("p_size") % 2 == 0, F.array_append("texts", F.lit("more"))).otherwise(F.slice("texts", 1, 1)))
    return incremental.manifest_rows(rows, "p_partkey")


def indexed_vectors(spark, d):
    index = tables.table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "lang")
    rows = vectors.join_vectors(index, tables.table(spark, d, "embeddings"), "vec_id")
    dropped = vectors.dropped_vectors(index, tables.table(spark, d, "embeddings"), "vec_id")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels")).join(F.broadcast(dropped), F.lit(True))


def context_vectors(spark, d):
    own = conversations(spark, d).where("turn % 3 <> 1").select("conv_id", "turn", F.array(F.length("text").cast("double"), F.lit(1.0)).alias("vector"))
    rows = turns.context_vectors(turns.context_window(conversations(spark, d), 4), own, 2, 4)
    return rows.select("conv_id", "at", "slot", F.get("vector", 0).alias("x"), F.get("vector", 1).alias("y"))


def system_table(spark, d):
    rows = tables.table(spark, d, "embeddings").withColumn("system", F.concat(F.lit("s"), (F.col("vec_id") % 3).cast("string")))
    out = vectors.system_table(rows, "system", "label", "embedding")
    return out.select("system", "groups", "utterances", *(rounded(c, 6).alias(c) for c in ("within", "between", "ratio")))


def retained_fraction(spark, d):
    rows = _parts(spark, d).select("p_partkey", vectors.retained(F.when(F.col("p_size") % 5 != 0, F.col("p_size").cast("double")).otherwise(0.0), F.col("p_retailprice")).alias("x"))
    return rows.select("p_partkey", rounded("x", 6).alias("retained"))


def _collected(spark, d):
    turn = F.struct(F.col("role").alias("speaker"), F.col("text").alias("content"), F.col("turn").cast("double").alias("time"))
    c = F.col("conv_id")
    own = conversations(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))).alias("ts"))
    own = own.select("conv_id", F.transform("ts", lambda x: x["t"]).alias("turns"))
    stem = F.concat(F.lit("v"), (c % 10).cast("string"), F.when(c % 13 == 0, "-take3").when(c % 4 == 0, "_long").otherwise(""))
    texts = own.select(
        F.concat(F.lit("r"), c.cast("string")).alias("rel"), F.concat(F.lit("s"), (c % 3).cast("string")).alias("scenario"), F.lit("couple").alias("variant_type"), stem.alias("stem"),
        F.when(c % 2 == 0, F.concat(F.lit("v"), (c % 10).cast("string"), F.when(c % 4 == 0, "_long").otherwise(""))).alias("variant_name"), (c % 11 != 0).alias("parsed"),
        F.when(c % 17 == 0, F.array().cast(own.schema["turns"].dataType)).otherwise(F.col("turns")).alias("turns"), "conv_id")
    wavs = own.where("conv_id % 7 <> 0").select(F.concat(F.lit("r"), c.cast("string")).alias("rel"), (c % 50 * 1.5).cast("double").alias("duration"), F.when(c % 3 == 0, 24000).otherwise(44100).alias("rate"), F.lit(1).alias("channels"))
    configs = spark.range(10).where("id not in (3, 6)").select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("config_key"), F.concat(F.lit("cat"), (F.col("id") % 4).cast("string")).alias("config"))
    onsets = own.where("conv_id % 3 = 0").select(F.concat(F.lit("r"), c.cast("string")).alias("rel"), F.transform(F.sequence(F.lit(1), F.size("turns") + F.when(c % 6 == 0, 1).otherwise(0)), lambda i: i * 2.5).alias("onsets"))
    return release.collect(texts, wavs, configs, onsets, ["assistant"])


def release_collect(spark, d):
    rows = _collected(spark, d)
    return rows.select("conv_id", "id", "group_key", "num_turns", "has_va", "times_recovered", "exported", F.coalesce("problem", F.lit("")).alias("problem"), F.array_join("speakers", ",").alias("speakers"), F.get("turns", 0)["time"].alias("first_time"))


def release_problems(spark, d):
    return release.problems(_collected(spark, d))


def release_report(spark, d):
    rows = _collected(spark, d).where("exported")
    return release.report(rows, assign(bucket("release-v1", F.col("group_key")))).withColumn("hours", rounded("hours", 6))


def release_formats(spark, d):
    return release.formats(_collected(spark, d).where("exported"))


def achieved_sizes(spark, d):
    rows = tables.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("system"), F.col("l_suppkey").alias("speaker"))
    return release.achieved_sizes(rows, "system", "speaker")


QUERIES = {f.__name__: f for f in (
    first_interaction, planned_turn_times, sampled_gaps, pause_statistics, starts_filled, early_stop, score_distribution, losses, learning_rates, pooled_vectors, config_hashes,
    referenced_characters, speech_staleness, usable_utterances, outputs_missing, stale_listing, usage_caps, share_projection, scenario_union, scenario_metrics, missing_fields,
    missing_speakers, single_speakers, errors_by_type, wanted_rows, speaker_texts, speaker_clips, manifest_pairs, indexed_vectors, context_vectors, system_table, retained_fraction,
    release_collect, release_problems, release_report, release_formats, achieved_sizes,
)}

_K = "conv_id || '/' || turn"
_TURN_TIMES = f"""with recursive n as (select *, row_number() over (partition by conv_id order by turn) as i,
  0.5::double + {HASH.format(seed="plan-v1-delay", key=_K)} * 1.5::double + (-0.3::double + {HASH.format(seed="plan-v1-variance", key=_K)} * 0.6::double) as wait, length(text) / 11.0::double as spoken from conversations),
o(conv_id, turn, i, s, e) as (select conv_id, turn, i, greatest(wait, 0), greatest(wait, 0) + spoken from n where i = 1
  union all select n.conv_id, n.turn, n.i, greatest(o.e + n.wait, 0), greatest(o.e + n.wait, 0) + n.spoken from o join n on n.conv_id = o.conv_id and n.i = o.i + 1)"""
_CLIP_ROWS = "c as (select l_suppkey as speaker, l_partkey % 40 as text_id, l_orderkey * 10 + l_linenumber as position, l_linenumber % 2 + 1 as mic, l_quantity as duration from lineitem)"
_BETWEEN_SYSTEMS = """e as (select *, 's' || (vec_id % 3) as system from embeddings),
p as (select system, label, i, avg(x) as x, sum(x) as s, sum(x * x) as q, count(*) as n from (select system, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from e) group by all),
v as (select system, label, list(x order by i) as v, max(n) as n, sum(s * s - q) as twice from p group by all),
m as (select system, label, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) as v, n, n * (n - 1) / 2 as pairs, n * (n - 1) / 2 - twice / 2 as total from v),
w as (select system, count(*) as groups, sum(n)::bigint as utterances, sum(total) / sum(pairs) as within from m group by 1),
b as (select a.system, avg(1 - list_inner_product(a.v, b.v)) as between from m a join m b on a.system = b.system and a.label < b.label group by 1)"""
_RELEASE = f"""n as (select conv_id, count(*) as n, string_agg(distinct role, ',' order by role) as speakers, min(turn)::double as t0 from conversations group by 1),
t as (select *, 'v' || (conv_id % 10) || case when conv_id % 13 = 0 then '-take3' when conv_id % 4 = 0 then '_long' else '' end as stem,
  case when conv_id % 2 = 0 then 'v' || (conv_id % 10) || case when conv_id % 4 = 0 then '_long' else '' end end as given from n),
r as (select *, coalesce(given, stem) as name, case when conv_id % 17 = 0 then 0 else n end as turns, conv_id % 10 as k from t where not ends_with(stem, '-take3')),
c as (select *, case when k not in (3, 6) then 'cat' || (k % 4) end as category, conv_id % 3 = 0 as has_onsets, n + case when conv_id % 6 = 0 then 1 else 0 end as onsets from r),
p as (select *, case when conv_id % 7 = 0 then 'no matching wav' when conv_id % 11 = 0 then 'unreadable json' when turns = 0 then 'no turns' when category is null then 'no config'
  when has_onsets and onsets <> turns then 'onset count differs' else '' end as problem, has_onsets and onsets = turns as recovered from c),
o as (select conv_id, concat_ws('/', category, 'couple', name) as id, concat_ws('/', category, 'couple', regexp_replace(name, '(_(long|variant[0-9]+))+$', '')) as group_key, turns as num_turns,
  turns > 0 and contains(',' || speakers || ',', ',assistant,') as has_va, recovered as times_recovered, problem in ('', 'onset count differs') as exported, problem, case when turns > 0 then speakers else '' end as speakers,
  case when turns = 0 then null when recovered then 2.5::double else t0 end as first_time,
  case when conv_id % 7 <> 0 then (conv_id % 50 * 1.5)::double end as duration, case when conv_id % 7 <> 0 then case when conv_id % 3 = 0 then 24000 else 44100 end end as rate, case when conv_id % 7 <> 0 then 1 end as channels from p)"""
_FIVE = "coalesce(min(n_chars), 0)::double as n_chars_min, coalesce(max(n_chars), 0)::double as n_chars_max, coalesce(avg(n_chars), 0)::double as n_chars_mean, coalesce(median(n_chars), 0)::double as n_chars_median, round(coalesce(stddev_samp(n_chars), 0), 6) as n_chars_stdev, count(n_chars) as n_chars_count"

ORACLE = {
    "first_interaction": "select conv_id, turn, not coalesce(bool_or(role = 'assistant') over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), false) as first_interaction from conversations",
    "planned_turn_times": f"{_TURN_TIMES} select conv_id, turn, round(s, 1) as time from o",
    "sampled_gaps": f"""with n as (select *, lead(case when turn % 5 = 2 then 'cut_in' end) over w as tag, lead(len(regexp_extract_all(text, '\\S+'))) over w as words from conversations window w as (partition by conv_id order by turn)),
h as (select *, {HASH.format(seed="gaps-v1", key=_K)} as u, {HASH.format(seed="gaps-v1-draw", key=_K)} as draw from n)
select conv_id, turn, round(case when words is null then null when tag = 'cut_in' then -(0.5 + u) when conv_id % 2 = 0 and draw < case when words <= 4 then 0.4 else 0.2 end then -(0.15::double + u * (0.8::double - 0.15::double)) else 0.3::double + u * (1.2::double - 0.3::double) end, 6) as gap from h""",
    "pause_statistics": f'with {_TIMED}, g as (select round("end" - start, 3) as gap from spans) select count(*) as n, round(sum(gap), 3) as total, min(gap) as least, max(gap) as most from g',
    "starts_filled": """with recursive n as (select conv_id, row_number() over (partition by conv_id order by turn) - 1 as i, case when (conv_id + turn) % 3 <> 0 then ((turn * 7 + conv_id) % 20)::double end as s from conversations),
x as (select *, coalesce(first_value(s ignore nulls) over (partition by conv_id order by i rows between 1 following and unbounded following), 16) as after from n),
f(conv_id, i, v) as (select conv_id, i, coalesce(s, round(after / 2, 2)) from x where i = 0 union all select x.conv_id, x.i, coalesce(x.s, round((f.v + x.after) / 2, 2)) from f join x on x.conv_id = f.conv_id and x.i = f.i + 1)
select conv_id, i, least(max(v) over (partition by conv_id order by i), 16) as start from f""",
    "early_stop": """with r as (select event_id as seq, event_type not in ('error', 'click') as ok from events), i as (select *, sum(ok::int) over (order by seq) as g from r),
f as (select *, sum((not ok)::int) over (partition by g order by seq) as k from i), s as (select min(seq) as stop from f where k >= 4)
select count(*) as n, max(seq) as last from r, s where stop is null or seq <= stop""",
    "score_distribution": f"with {scored_sql()} select round(avg(score) filter (expected), 9) as mean_positive, round(min(score) filter (expected), 9) as min_positive, round(max(score) filter (expected), 9) as max_positive, round(avg(score) filter (not expected), 9) as mean_negative from s",
    "losses": f"""with {scored_sql()}, z as (select conv_id, turn, score * 8 - 4 as z, case when expected then 0.95::double else 0.05::double end as y from s)
select conv_id, turn, round(1 / (1 + exp(-z)), 6) as p, 1 / (1 + exp(-z)) > 0.5 as fires, round(3 * y * ln(1 + exp(-z)) + (1 - y) * ln(1 + exp(z)), 6) as loss from z""",
    "learning_rates": "select event_id as step, round(case when event_id < 50 then 0.001::double * event_id / 50 else 0.0005::double * (1 + cos(pi() * least(1, (event_id - 50) / 350.0::double))) end, 9) as rate from events where event_id < 500",
    "pooled_vectors": """with v as (select vec_id, embedding::double[] as v, list_reverse(embedding::double[]) as r, [exp(0.5), exp((vec_id % 3)::double), exp(-1.0)] as w from embeddings),
a as (select vec_id, v, r, list_transform(range(1, len(v) + 1), lambda i: (w[1] * v[i] - 0.5 * w[2] * v[i] + w[3] * r[i]) / (w[1] + w[2] + w[3])) as a,
  list_transform(range(1, len(v) + 1), lambda i: (v[i] * 0.5 + r[i]) / 3) as m, list_transform(range(1, len(v) + 1), lambda i: greatest(v[i], -0.5 * v[i], r[i])) as x from v)
select vec_id, round(list_sum(list_transform(a, lambda y: abs(y))), 5) as attention, round(a[1], 6) as first, len(m) + len(x) as size, round(list_sum(list_transform(m, lambda y: abs(y))) + list_sum(list_transform(x, lambda y: abs(y))), 5) as mean_max from a""",
    "config_hashes": """select p_partkey, md5('{"a.json": "' || md5(p_type) || '", "b.json": "' || md5(p_name) || '"}') as composite, sha256(p_brand || '|' || p_name) as joined from part""",
    "referenced_characters": """with n as (select p_partkey as config, unnest(list_distinct(list_concat(case when p_size % 3 <> 0 then [split_part(p_name, ' ', 1)] else [] end, case when p_size % 4 <> 0 then [split_part(p_name, ' ', -1)] else [] end))) as character from part)
select character, config from n where character in (select split_part(p_name, ' ', -1) from part where p_size > 5 union select split_part(p_name, ' ', 1) from part where p_size < 3)""",
    "speech_staleness": f"""with s as (select {", ".join(_SPEECH)} from part)
select p_partkey, case when not has_output or code_version is null or not starts_with(code_version, '1.2.') or recorded_hash is distinct from speech_hash then 'full' when recorded_background is distinct from background_hash then 'background_only' else 'none' end as redo from s""",
    "usable_utterances": """with r as (select l_orderkey, case when l_linenumber = 7 then null when l_partkey % 9 = 0 then 44100 else 24000 end as rate, l_orderkey % 5 + 1 as expected from lineitem)
select l_orderkey, count(*) = max(expected) and count(distinct rate) = 1 and count(*) filter (rate is null) = 0 as usable from r group by 1""",
    "outputs_missing": "select replace(p_name, ' ', '_') || p_partkey as key, p_partkey from part where p_partkey % 3 <> 0 and p_partkey % 4 <> 0",
    "stale_listing": f"""with k as (select *, {_LEDGER_KEY} as key, case when p_partkey % 5 <> 0 then '1.' || (p_partkey % 3) || '.0' end as v from part)
select key, case when p_partkey % 9 = 0 then 'malformed key' when p_partkey % 8 = 0 then 'config missing' when v is null then 'no code version' when p_partkey % 3 <> 2 then 'code version'
  when p_partkey % 6 = 1 and p_name <> p_type then 'config: c.json' when p_partkey % 7 = 0 then 'hash' end as reason from k where reason is not null""",
    "usage_caps": "select l_suppkey, count(distinct l_orderkey) as files, greatest(1, floor(count(distinct l_orderkey) * 0.15::double))::int as cap from lineitem group by 1",
    "share_projection": """select count(*) as n, count(*) filter (lang = 'de') as "having", round(count(*) filter (lang = 'de') / count(*)::double, 9) as share, round((count(*) filter (lang = 'de') + 40) / (count(*) + 40)::double, 9) as after from documents""",
    "scenario_union": "select source || '/' || lang as scenario, bool_or(doc_id % 3 = 0) as is_generated from documents where doc_id % 3 = 0 or doc_id % 5 = 0 group by 1",
    "scenario_metrics": f"""with s as (select source || '/' || lang as scenario, * from documents), g as (select * from s where doc_id % 3 <> 0)
select scenario, count(n_chars) > 0 as is_generated, count(n_chars) as files, {_FIVE} from (select scenario from s where doc_id % 3 <> 0 or doc_id % 4 = 0 group by 1) k left join g using (scenario) group by 1""",
    "missing_fields": "select conv_id, turn, 'warning' as severity, 'missing_fields' as type, case (conv_id + turn) % 5 when 0 then 'content' else 'speaker, content' end as message from conversations where (conv_id + turn) % 5 in (0, 2)",
    "missing_speakers": "select conv_id, turn from conversations where turn % 4 in (1, 2)",
    "single_speakers": "select conv_id, count(distinct case when conv_id % 6 = 0 then 'user' else role end) as speakers from conversations where conv_id % 2 = 0 group by 1 having speakers = 1",
    "errors_by_type": f"""with n as (select *, row_number() over (partition by conv_id order by turn) - 1 as i, lag(text) over (partition by conv_id order by turn) as b, sum((role = 'assistant')::int) over (partition by conv_id order by turn) as k from conversations),
w as (select conv_id, count(*) as n, md5(string_agg(text, ' ' order by turn)) as h from conversations group by 1),
e as (select 'invocation_missing' as type from n where role = 'assistant' and k = 1 and i > 0 and not contains(lower(b), 'that')
  union all select 'filler_words' from n where role = 'assistant' and list_has_any(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), ['thst', 'ly', 'er'])
  union all select 'short_dialogue' from w where n < 4 union all select 'duplicate_dialogue' from w group by h having count(*) > 1)
select type, count(*) as errors, row_number() over (order by count(*) desc, type) as place from e group by 1""",
    "wanted_rows": """with r as (select p_partkey::varchar as id, p_brand as category, p_size > 20 as has_va from part)
(select * from r where category = 'Brand#2' and has_va order by id limit 20) union all select * from r where id in ('3', '17', 'x')""",
    "speaker_texts": f"""with {_CLIP_ROWS}, u as (select speaker, position, min(text_id) as text_id, min(mic) as mic from c group by all),
o as (select speaker, text_id, min(position) as position from u where mic = 1 group by all), s as (select *, row_number() over (partition by speaker order by position) as n from o),
f as (select speaker from s where n <= 5 group by 1 having count(*) = 5 order by max(position) limit 10) select speaker, text_id, position from s where n <= 5 and speaker in (select speaker from f)""",
    "speaker_clips": f"""with {_CLIP_ROWS}, u as (select speaker, position * 1000 + speaker as position, min(duration) as duration from c group by speaker, c.position),
o as (select speaker, min(position) as position, arg_min(duration, position) as duration from u where duration between 10 and 12 group by 1) select speaker, position, duration from o order by position limit 15""",
    "manifest_pairs": """with a as (select p_partkey, string_split(p_name, ' ') as p, case when p_size % 2 = 0 then list_append(string_split(p_type, ' '), 'more') else string_split(p_type, ' ')[1:1] end as t from part),
i as (select *, unnest(range(0, least(len(p), len(t)))) as i from a) select p_partkey, i, p[i + 1] as path, t[i + 1] as text from i""",
    "indexed_vectors": """select lang, count(*) as n, count(distinct label) as labels, (select count(*) from documents where doc_id not in (select vec_id from embeddings)) as dropped from documents join embeddings on doc_id = vec_id group by 1""",
    "context_vectors": """with n as (select *, row_number() over (partition by conv_id order by turn) as i from conversations), s as (select conv_id, turn, i, unnest(range(0, 4)) as slot from n where role <> 'assistant')
select s.conv_id, s.turn as at, s.slot, case when n.turn % 3 <> 1 then length(n.text)::double else 0 end as x, case when n.turn % 3 <> 1 then 1::double else 0 end as y
from s left join n on n.conv_id = s.conv_id and n.i = s.i - 4 + s.slot""",
    "system_table": f"with {_BETWEEN_SYSTEMS} select system, groups, utterances, round(within, 6) as within, round(between, 6) as between, round(between / within, 6) as ratio from w left join b using (system)",
    "retained_fraction": "select p_partkey, round(p_retailprice / case when p_size % 5 <> 0 then p_size end, 6) as retained from part",
    "release_collect": f"with {_RELEASE} select conv_id, id, group_key, num_turns, has_va, times_recovered, exported, problem, speakers, first_time from o",
    "release_problems": f"with {_RELEASE} select problem, count(*) as files from o where problem <> '' group by 1",
    "release_report": f"""with {_RELEASE}, h as (select *, {HASH.format(seed="release-v1", key="group_key")} as u from o where exported),
s as (select *, case when u < 0.8 then 'train' when u < 0.9 then 'validation' else 'test' end as split from h)
select coalesce(split, 'total') as split, count(*) as n, count(distinct group_key) as groups, round(coalesce(sum(duration), 0) / 3600, 6) as hours, count(*) filter (has_va) as va, count(*) filter (not has_va) as no_va,
  count(*) filter (not times_recovered) as estimated from s group by rollup (split)""",
    "release_formats": f"with {_RELEASE} select rate, channels, count(*) as n, sum(duration * rate * 2) as pcm_bytes from o where exported group by all",
    "achieved_sizes": "select l_returnflag as system, count(*) as entries, count(distinct l_suppkey) as speakers from lineitem group by 1",
}
