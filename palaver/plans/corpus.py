"""Queries over documents, labels and conversations: splitting, detectors, corpus statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.functions import text as tx
from palaver.functions.hashing import assign, bucket
from palaver.functions.numbers import rounded
from palaver.operators import quality, split, turns
from palaver.plans.conversations import HASH, _TIMED, WAKE, conversations, timed
from palaver.sources.tables import table

SEED = "corpus-v1"
FILLERS = ("thst", "ly", "er")


def documents(spark, d):
    return table(spark, d, "documents")


def _named(spark, d):
    """Parts stand for variations: brand, type and a name with suffixes of the tools."""
    n = F.col("p_partkey")
    name = F.concat(F.when(n % 3 == 0, "no_va_").otherwise(""), F.translate("p_name", " ", "_"), F.when(n % 4 == 0, "_long").when(n % 4 == 1, "_variant2").when(n % 4 == 2, "_variant1_long").otherwise(""))
    return table(spark, d, "part").select("p_partkey", name.alias("name"), tx.group_key(F.col("p_brand"), F.col("p_type"), name).alias("group_key"))


def split_group_key(spark, d):
    return _named(spark, d)


def split_hash_bucket(spark, d):
    return documents(spark, d).select("doc_id", rounded(bucket("s", F.col("doc_id").cast("string")), 12).alias("position"))


def _split_docs(spark, d, seed=SEED):
    """A group is a source with a hundred neighbouring documents."""
    key = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 100).cast("string"))
    return split.assign_splits(documents(spark, d).select("doc_id", "source", "lang", "n_chars", key.alias("group_key")), "group_key", seed)


def split_assign(spark, d):
    return _split_docs(spark, d).select("doc_id", "group_key", "split")


def split_report(spark, d):
    return split.report(_split_docs(spark, d), seconds=F.col("n_chars") / 11.0, silent=F.col("lang") != "en", turns=F.lit(1))


def split_leakage(spark, d):
    rows = documents(spark, d).select(F.concat_ws("/", "source", "lang").alias("group_key"), assign(bucket(SEED, F.col("doc_id").cast("string"))).alias("split"))
    return split.leakage(rows)


def split_category_gap(spark, d):
    rows = split.category_gap(_split_docs(spark, d).select(F.concat_ws("/", "source", "lang").alias("category"), "split"), "category")
    return rows.select("category", F.array_join("missing", ",").alias("missing"))


def _manifest(spark, d, seed, skip):
    rows = _split_docs(spark, d, seed).select("group_key", "split").distinct()
    return rows.where(F.length("group_key") % 5 != skip)


def split_drift(spark, d):
    return split.drift(_manifest(spark, d, SEED, 0), _manifest(spark, d, "split-v1", 1))


def split_manifest_join(spark, d):
    rows = _split_docs(spark, d).select("doc_id", "group_key")
    return split.with_manifest(rows, _manifest(spark, d, "split-v1", 0), "group_key", SEED).select("doc_id", "group_key", "split", "listed")


def detect_short_dialogue(spark, d):
    return quality.short_dialogues(quality.conversation_sizes(conversations(spark, d)))


def detect_empty_utterance(spark, d):
    blank = F.when((F.col("conv_id") + F.col("turn")) % 9 == 0, F.lit("  ")).when((F.col("conv_id") + F.col("turn")) % 9 != 1, F.col("text"))
    return quality.empty_utterances(conversations(spark, d).withColumn("text", blank)).select("conv_id", "turn")


def detect_duplicate_dialogue(spark, d):
    rows = conversations(spark, d).withColumn("text", F.concat("role", (F.length("text") % 2).cast("string")))
    return quality.duplicate_dialogues(rows)


def detect_duplicate_docs(spark, d):
    return quality.duplicate_texts(documents(spark, d), "doc_id", F.col("text"))


def detect_invocation_missing(spark, d):
    return quality.missing_invocations(conversations(spark, d), WAKE).select("conv_id", "turn", "i")


def detect_filler_words(spark, d):
    return quality.filler_words(conversations(spark, d), FILLERS).select("conv_id", "turn", F.array_join("fillers", ",").alias("fillers"), "preview")


def error_summary(spark, d):
    return quality.error_summary(quality.all_errors(conversations(spark, d), WAKE, FILLERS))


def missing_scenarios(spark, d):
    expected = documents(spark, d).select(F.concat_ws("/", "source", "lang").alias("scenario"))
    actual = documents(spark, d).join(table(spark, d, "labels"), "doc_id").where("toxic = 1").select(F.concat_ws("/", "source", "lang").alias("scenario"))
    return quality.missing_keys(expected, actual, "scenario")


def duplicate_ids(spark, d):
    return quality.duplicate_ids(table(spark, d, "lineitem").select(F.concat_ws("/", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("id")), "id")


def onset_monotone(spark, d):
    moved = F.when((F.col("conv_id") + F.col("turn")) % 11 == 0, None).when((F.col("conv_id") + F.col("turn")) % 7 == 0, F.col("start") - 40).when((F.col("conv_id") + F.col("turn")) % 13 == 0, F.col("duration") + 1).otherwise(F.col("start"))
    return quality.onset_faults(timed(spark, d).withColumn("start", moved)).select("conv_id", "turn", "fault")


def cache_coverage(spark, d):
    return quality.cache_coverage(documents(spark, d), table(spark, d, "labels"), "doc_id").select("wanted", rounded("coverage", 9).alias("coverage"))


def conv_quality_per_dialogue(spark, d):
    rows = quality.dialogue_quality(conversations(spark, d))
    return rows.select("conv_id", "turns", "words", "chars", rounded("words_per_turn", 6).alias("words_per_turn"), rounded("chars_per_turn", 6).alias("chars_per_turn"))


def _rounded(rows):
    return rows.select(*(rounded(c, 4).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes))


def quality_stats(spark, d):
    return _rounded(quality.dialogue_quality(conversations(spark, d)).agg(*quality.five_numbers("turns"), *quality.five_numbers("words")))


def quality_by_scenario(spark, d):
    return _rounded(quality.quality_by(quality.text_counts(documents(spark, d)), "source", ("words", "chars")))


def coverage_counts(spark, d):
    return quality.coverage(documents(spark, d), "source", "lang")


def speaker_frequency(spark, d):
    return quality.speaker_frequency(conversations(spark, d))


def top_speakers(spark, d):
    first = F.struct("conv_id", "turn")
    return quality.most_common(conversations(spark, d), "role", first, 10).select("role", "n", F.col("first_seen.conv_id").alias("first_conv"))


QUERIES = {f.__name__: f for f in (
    split_group_key, split_hash_bucket, split_assign, split_report, split_leakage, split_category_gap, split_drift, split_manifest_join,
    detect_short_dialogue, detect_empty_utterance, detect_duplicate_dialogue, detect_duplicate_docs, detect_invocation_missing, detect_filler_words, error_summary,
    missing_scenarios, duplicate_ids, onset_monotone, cache_coverage, conv_quality_per_dialogue, quality_stats, quality_by_scenario, coverage_counts, speaker_frequency, top_speakers,
)}

_ASSIGN = "case when {p} < 0.8 then 'train' when {p} < 0.9 then 'validation' else 'test' end"
_GROUP = "source || '/' || lang || '/' || (doc_id // 100)"


def _docs(name, seed):
    return f"{name} as (select doc_id, source, lang, n_chars, {_GROUP} as group_key, {_ASSIGN.format(p=HASH.format(seed=seed, key='(' + _GROUP + ')'))} as split from documents)"


def _stats(v):
    return ", ".join(f"round(coalesce({f}({v}::double), 0), 4) as {v}_{n}" for f, n in (("min", "min"), ("max", "max"), ("avg", "mean"), ("median", "median"), ("stddev_samp", "stdev"))) + f", count({v}) as {v}_count"


_PER = """q as (select conv_id, count(*) as turns, sum(len(regexp_extract_all(text, '\\S+')))::bigint as words, sum(length(text))::bigint as chars,
avg(len(regexp_extract_all(text, '\\S+'))) as words_per_turn, avg(length(text)) as chars_per_turn from conversations group by 1)"""
_INVOKED = """i as (select *, row_number() over w - 1 as i, lag(text) over w as before, sum((role = 'assistant')::int) over (partition by conv_id order by turn) as k from conversations window w as (partition by conv_id order by turn)),
inv as (select conv_id, turn, i from i where role = 'assistant' and k = 1 and i > 0 and not contains(lower(coalesce(before, '')), 'that'))"""
_FILLED = """f as (select conv_id, turn, text, list_filter(['thst', 'ly', 'er'], lambda w: list_contains(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+'), w)) as x from conversations where role = 'assistant'),
fil as (select conv_id, turn, array_to_string(x, ',') as fillers, case when length(text) > 100 then substr(text, 1, 100) || '...' else text end as preview from f where len(x) > 0)"""
_SIZES = "z as (select conv_id, count(*) as turns from conversations group by 1)"

ORACLE = {
    "split_group_key": """with n as (select *, case when p_partkey % 3 = 0 then 'no_va_' else '' end || replace(p_name, ' ', '_') ||
  case p_partkey % 4 when 0 then '_long' when 1 then '_variant2' when 2 then '_variant1_long' else '' end as name from part)
select p_partkey, name, p_brand || '/' || p_type || '/' || regexp_replace(regexp_replace(name, '^no_va_', ''), '(_(long|variant[0-9]+))+$', '') as group_key from n""",
    "split_hash_bucket": f"select doc_id, round({HASH.format(seed='s', key='doc_id')}, 12) as position from documents",
    "split_assign": f"with {_docs('a', SEED)} select doc_id, group_key, split from a",
    "split_report": f"""with {_docs('a', SEED)} select coalesce(split, 'total') as split, count(*) as conversations, count(distinct group_key) as groups, count(*) as turns,
round(sum(n_chars / 11.0::double) / 3600, 6) as hours, round(avg((lang <> 'en')::int), 6) as silent_share, round(count(*) / (select count(*) from a), 6) as share from a group by rollup (split)""",
    "split_leakage": f"""with a as (select source || '/' || lang as group_key, {_ASSIGN.format(p=HASH.format(seed=SEED, key='doc_id'))} as split from documents)
select group_key, count(distinct split) as splits from a group by 1 having count(distinct split) > 1""",
    "split_category_gap": f"""with {_docs('a', SEED)}, c as (select source || '/' || lang as category, list_distinct(list(split)) as h from a group by 1)
select category, array_to_string(list_sort(list_filter(['train', 'validation', 'test'], lambda s: not list_contains(h, s))), ',') as missing from c where len(h) < 3""",
    "split_drift": f"""with {_docs('a', SEED)}, {_docs('b', 'split-v1')}, o as (select distinct group_key, split from a where length(group_key) % 5 <> 0), n as (select distinct group_key, split from b where length(group_key) % 5 <> 1)
select group_key, o.split as old_split, n.split as new_split, case when o.split is null then 'added' when n.split is null then 'removed' else 'moved' end as change
from o full join n using (group_key) where o.split is distinct from n.split""",
    "split_manifest_join": f"""with {_docs('a', SEED)}, {_docs('b', 'split-v1')}, n as (select distinct group_key, split from b where length(group_key) % 5 <> 0)
select doc_id, group_key, coalesce(n.split, a.split) as split, n.split is not null as listed from a left join n using (group_key)""",
    "detect_short_dialogue": f"with {_SIZES} select conv_id, turns, 'short_dialogue' as type from z where turns < 4",
    "detect_empty_utterance": "select conv_id, turn from conversations where (conv_id + turn) % 9 in (0, 1) or trim(text) = ''",
    "detect_duplicate_dialogue": """with w as (select conv_id, md5(string_agg(role || (length(text) % 2), ' ' order by turn)) as hash from conversations group by 1)
select hash, count(*) as copies, min(conv_id) as first from w group by 1 having count(*) > 1""",
    "detect_duplicate_docs": "select md5(coalesce(text, '')) as hash, count(*) as copies, min(doc_id) as first from documents group by 1 having count(*) > 1",
    "detect_invocation_missing": f"with {_INVOKED} select * from inv",
    "detect_filler_words": f"with {_FILLED} select * from fil",
    "error_summary": f"""with {_INVOKED}, {_FILLED}, {_SIZES}, w as (select md5(string_agg(text, ' ' order by turn)) as h from conversations group by conv_id),
e as (select 'critical' as severity, 'invocation_missing' as type from inv union all select 'critical', 'filler_words' from fil union all select 'critical', 'short_dialogue' from z where turns < 4
  union all select 'warning', 'empty_utterance' from conversations where trim(text) = '' union all select 'warning', 'duplicate_dialogue' from (select h from w group by 1 having count(*) > 1))
select coalesce(severity, 'total') as severity, coalesce(type, 'all') as type, count(*) as errors from e group by rollup (severity, type)""",
    "missing_scenarios": """select distinct source || '/' || lang as scenario from documents
except select source || '/' || lang from documents join labels using (doc_id) where toxic = 1""",
    "duplicate_ids": "select l_partkey || '/' || l_suppkey as id, count(*) as copies from lineitem group by 1 having count(*) > 1",
    "onset_monotone": f"""with {_TIMED}, m as (select conv_id, turn, duration, case when (conv_id + turn) % 11 = 0 then null when (conv_id + turn) % 7 = 0 then start - 40 when (conv_id + turn) % 13 = 0 then duration + 1 else start end as start from timed),
n as (select *, max(start) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as earlier from m)
select conv_id, turn, case when start is null then 'missing' when start > duration then 'beyond' else 'not_monotone' end as fault from n where start is null or start > duration or start < earlier""",
    "cache_coverage": "select count(*) as wanted, round(avg((doc_id in (select doc_id from labels))::int), 9) as coverage from documents",
    "conv_quality_per_dialogue": f"with {_PER} select conv_id, turns, words, chars, round(words_per_turn, 6) as words_per_turn, round(chars_per_turn, 6) as chars_per_turn from q",
    "quality_stats": f"with {_PER} select {_stats('turns')}, {_stats('words')} from q",
    "quality_by_scenario": f"""with x as (select source, len(regexp_extract_all(text, '\\S+')) as words, length(text) as chars from documents)
select coalesce(source, 'overall') as source, count(*) as files, {_stats('words')}, {_stats('chars')} from x group by rollup (source)""",
    "coverage_counts": "select source, count(*) as files, count(distinct lang) as variants, string_agg(distinct lang, ',' order by lang) as names from documents group by 1",
    "speaker_frequency": "select role, count(*) as turns, count(distinct conv_id) as conversations from conversations group by 1",
    "top_speakers": "select role, count(*) as n, min(conv_id) as first_conv from conversations group by 1 order by n desc limit 10",
}
