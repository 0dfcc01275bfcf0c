"""Queries over conversations: labels, spans, contexts, schedules and detection quality.

The assistant is the role `assistant`; its name is the word `that`, which the texts hold.
Scores stand in for a model's: a stable hash of the turn, raised where a reply is expected.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.functions import text as tx
from palaver.functions.hashing import bucket
from palaver.functions.numbers import rounded
from palaver.operators import detect, turns
from palaver.sources.tables import table

WAKE = "that"
SCENE_SECONDS = 60.0


def conversations(spark, d):
    return table(spark, d, "conversations")


def labelled(spark, d):
    return turns.label_turns(conversations(spark, d), WAKE)


def _key():
    return F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))


def _score(seed):
    return bucket(seed, _key()) * 0.6 + F.when(F.col("expected"), 0.4).otherwise(0.0)


def scored(spark, d, seed="score-v1"):
    return labelled(spark, d).withColumns({"score": _score(seed), "seconds": F.length(tx.empty(F.col("text"))) / turns.CHARS_PER_SECOND})


def timed(spark, d):
    return turns.planned_times(conversations(spark, d))


def r(col, n=6):
    return rounded(col, n).alias(col) if isinstance(col, str) else rounded(col, n)


def label_turns(spark, d):
    return labelled(spark, d).select("conv_id", "turn", "role", "expected", "trigger_type")


def label_balance(spark, d):
    return turns.label_balance(labelled(spark, d))


def turn_spans(spark, d):
    return turns.turn_spans(timed(spark, d)).select("conv_id", "turn", r("start"), r("end"))


def speaker_ids(spark, d):
    return turns.speaker_ids(conversations(spark, d)).select("conv_id", "role", "speaker_id")


def _listed(col):
    return F.array_join(F.transform(col, lambda x: x.cast("string")), ",")


def context_window(spark, d):
    rows = turns.context_window(conversations(spark, d))
    return rows.select("conv_id", "turn", F.size("context").alias("context_size"), _listed("context").alias("context"))


def context_matrix(spark, d):
    rows = turns.context_matrix(turns.context_window(conversations(spark, d)))
    return rows.select("conv_id", "turn", _listed("slots").alias("slots"), F.size(F.filter("mask", lambda m: m)).alias("padding"))


def since_last_turn(spark, d):
    rows = turns.since_last_turn(conversations(spark, d))
    return rows.select("conv_id", "turn", "role", F.size("since").alias("n_since"), _listed("since").alias("since"))


def wake_index(spark, d):
    return turns.wake_index(conversations(spark, d), WAKE)


def estimate_turn_starts(spark, d):
    return turns.estimate_turn_starts(conversations(spark, d), F.lit(SCENE_SECONDS)).select("conv_id", "turn", r("start", 1))


def scene_trim(spark, d):
    return turns.scene_trim(timed(spark, d), 3).select("conv_id", "turn", r("start", 3), rounded("scene_seconds", 1).alias("scene_seconds"))


def mix_offsets(spark, d):
    gap = bucket("gap-v1", _key()) * 4.0 - 3.0
    return turns.mix_offsets(turns.turn_spans(timed(spark, d)), gap).select("conv_id", "turn", r("offset", 4))


def turn_schedule(spark, d):
    phases = conversations(spark, d).select(
        F.col("conv_id").alias("scene"), F.lit(6).alias("max_turns"), F.col("turn").alias("phase_index"), F.concat(F.lit("p"), F.col("turn").cast("string")).alias("phase"),
        F.array("role", F.lit("assistant")).alias("speakers"), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5)) == 0).alias("silence"))
    return turns.turn_schedule(phases)


def ambient_remerge(spark, d):
    rows = timed(spark, d).withColumn("start", F.when(F.pmod(F.col("conv_id") + F.col("turn"), F.lit(7)) != 0, F.pmod(F.col("turn") * 5, F.lit(8)).cast("double")))
    spoken, ambient = turns.ambient_hold_out(rows, "system")
    return turns.ambient_remerge(spoken, ambient, F.col("start")).select("conv_id", "turn", "position")


def speaking_rate(spark, d):
    secs = F.length("text") / turns.CHARS_PER_SECOND
    words = tx.count_ascii_words(F.col("text"))
    return conversations(spark, d).select("conv_id", "turn", rounded(F.try_divide(words, F.nullif(secs, F.lit(0.0))), 6).alias("words_per_second"))


def wake_vocative(spark, d):
    return conversations(spark, d).select("conv_id", "turn", tx.is_addressed(F.col("text"), "the", openers=("and", "in", "to", "of", "on", "a", "for", "that")).alias("addressed"))


def confusion_by_type(spark, d):
    return detect.confusion(scored(spark, d))


def fa_per_hour(spark, d):
    return detect.false_accepts(scored(spark, d), 0.5).select("fp", r("hours"), r("speech_hours"), "fa_per_hour", "fa_per_speech_hour")


def _sweep_columns(rows):
    return detect.mark_best(rows).select(rounded("threshold", 2).alias("threshold"), "tp", "fp", "tn", "fn", "precision", "recall", "f1", "fa_per_hour", "fa_per_speech_hour", "is_best")


def threshold_sweep(spark, d):
    return _sweep_columns(detect.sweep(scored(spark, d)))


def ensemble_sweep(spark, d):
    """Three models' scores of each turn, made in one scan."""
    one = lambda k: F.struct(F.lit(k).alias("model"), _score(f"score-v{k}").alias("score"))
    rows = scored(spark, d).withColumn("s", F.explode(F.array(*map(one, (1, 2, 3))))).select("conv_id", "turn", "s.score", "expected", "seconds", "s.model")
    return _sweep_columns(detect.sweep(detect.ensemble(rows, ("conv_id", "turn"))))


def threshold_transfer(spark, d):
    rows = scored(spark, d)
    even = F.pmod("conv_id", F.lit(2)) == 0
    return detect.transfer(rows.where(even), rows.where(~even)).withColumn("threshold", rounded("threshold", 2))


QUERIES = {f.__name__: f for f in (
    label_turns, label_balance, turn_spans, speaker_ids, context_window, context_matrix, since_last_turn, wake_index, estimate_turn_starts, scene_trim, mix_offsets,
    turn_schedule, ambient_remerge, speaking_rate, wake_vocative, confusion_by_type, fa_per_hour, threshold_sweep, ensemble_sweep, threshold_transfer,
)}

HASH = "(('0x' || substr(sha256('{seed}:' || {key}), 1, 16))::ubigint::double / 18446744073709551616.0)"
_KEY = "conv_id || '/' || turn"
_LABELLED = """
t as (select *, coalesce(lead(role) over (partition by conv_id order by turn) = 'assistant', false) as expected from conversations),
l as (select *, case when not expected then 'non-assistance' when contains(lower(coalesce(text, '')), 'that') then 'direct' else 'contextual' end as trigger_type
  from t where role <> 'assistant')"""


def _scored(seeds=("score-v1",)):
    mean = "(" + " + ".join(f"(0.6::double * {HASH.format(seed=s, key=_KEY)} + case when expected then 0.4::double else 0::double end)" for s in seeds) + f") / {len(seeds)}::double"
    return _LABELLED + f", s as (select *, {mean} as score, length(coalesce(text, '')) / 11.0::double as seconds from l)"


_TIMED = """
timed as (select *, coalesce(sum(length(text) / 11.0::double) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as start,
  sum(length(text) / 11.0::double) over (partition by conv_id) as duration from conversations),
spans as (select *, coalesce(lead(start) over (partition by conv_id order by turn), duration) as "end" from timed)"""
_RATES = """round(coalesce(tp::double / nullif(tp + fp, 0), 0), 3) as precision, round(coalesce(tp::double / nullif(tp + fn, 0), 0), 3) as recall,
round(coalesce(2.0::double * tp / nullif(2 * tp + fp + fn, 0), 0), 3) as f1"""
_COUNTS = """count(*) filter (expected and score > {t}) as tp, count(*) filter (not expected and score > {t}) as fp,
count(*) filter (not expected and not score > {t}) as tn, count(*) filter (expected and not score > {t}) as fn"""
_HOURS = "sum(seconds) / 3600 as hours, sum(seconds) filter (not expected) / 3600 as speech_hours"
_PER_HOUR = "round(coalesce(fp / nullif(hours, 0), 0), 4) as fa_per_hour, round(coalesce(fp / nullif(speech_hours, 0), 0), 4) as fa_per_speech_hour"


def _sweep(seeds=("score-v1",)):
    return f"""with {_scored(seeds)}, g as (select i / 20.0::double as threshold from range(1, 20) r(i)),
c as (select threshold, {_COUNTS.format(t="threshold")}, {_HOURS} from s cross join g group by threshold),
p as (select *, {_RATES}, {_PER_HOUR} from c)
select round(threshold, 2) as threshold, tp, fp, tn, fn, precision, recall, f1, fa_per_hour, fa_per_speech_hour,
  row_number() over (order by f1 desc, threshold) = 1 and f1 > 0 as is_best from p"""


ORACLE = {
    "label_turns": f"with {_LABELLED} select conv_id, turn, role, expected, trigger_type from l",
    "label_balance": f"with {_LABELLED} select trigger_type, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 1) as pct from l group by 1",
    "turn_spans": f'with {_TIMED} select conv_id, turn, round(start, 6) as start, round("end", 6) as "end" from spans',
    "speaker_ids": """with f as (select conv_id, role, min(turn) as m from conversations group by all)
select conv_id, role, case when role = 'assistant' then 1 else 1 + dense_rank() over (partition by conv_id, role <> 'assistant' order by m) end as speaker_id from f""",
    "context_window": """with c as (select conv_id, turn, role, list(turn) over (partition by conv_id order by turn rows between 20 preceding and 1 preceding) as x from conversations)
select conv_id, turn, coalesce(len(x), 0) as context_size, coalesce(array_to_string(x, ','), '') as context from c where role <> 'assistant'""",
    "context_matrix": """with c as (select conv_id, turn, role, coalesce(list(turn) over (partition by conv_id order by turn rows between 20 preceding and 1 preceding), []) as x from conversations)
select conv_id, turn, array_to_string(list_concat(list_resize([]::bigint[], (20 - len(x))::bigint, -1), x), ',') as slots, 20 - len(x) as padding from c where role <> 'assistant'""",
    "since_last_turn": """with n as (select *, row_number() over (partition by conv_id order by turn) as i, max(turn) over (partition by conv_id, role order by turn rows between unbounded preceding and 1 preceding) as last from conversations),
j as (select a.conv_id, a.turn, a.role, b.turn as t from n a left join n b on a.conv_id = b.conv_id and b.i < a.i and case when a.last is null then b.i >= a.i - 2 else b.turn > a.last end)
select conv_id, turn, role, count(t) as n_since, coalesce(string_agg(t::varchar, ',' order by t), '') as since from j group by all""",
    "wake_index": """with n as (select *, row_number() over (partition by conv_id order by turn) - 1 as i from conversations),
f as (select conv_id, min(i) as first from n where role = 'assistant' group by 1)
select f.conv_id, max(i) filter (i < first and i >= first - 3 and contains(lower(text), 'that')) as wake_index from f join n using (conv_id) group by 1""",
    "estimate_turn_starts": """with n as (select *, greatest(length(coalesce(text, '')), 1) as c, count(*) over (partition by conv_id) as k from conversations),
p as (select *, greatest(60.0::double - 0.75 * (k - 1), 30) / sum(c) over (partition by conv_id) as rate,
  coalesce(sum(c) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as b, row_number() over (partition by conv_id order by turn) - 1 as i from n)
select conv_id, turn, round(round(b * rate + 0.75 * i, 2), 1) as start from p""",
    "scene_trim": f"""with {_TIMED}, n as (select *, row_number() over (partition by conv_id order by turn) - 1 as i from timed),
c as (select conv_id, max(start) filter (i = 3) as a, max(start) filter (i = 2) as b, max(duration) as d from n group by 1)
select n.conv_id, turn, round(start, 3) as start, round(case when a is null then d else round(least(a, b + 6), 2) end, 1) as scene_seconds from n join c using (conv_id) where i < 3""",
    "mix_offsets": f"""with recursive {_TIMED}, n as (select *, row_number() over (partition by conv_id order by turn) as i, "end" - start as len, {HASH.format(seed="gap-v1", key=_KEY)} * 4 - 3 as gap from spans),
o(conv_id, turn, i, len, gap, pos) as (select conv_id, turn, i, len, gap, 0::double from n where i = 1
  union all select n.conv_id, n.turn, n.i, n.len, n.gap, greatest(o.pos + o.len + o.gap, 0) from o join n on n.conv_id = o.conv_id and n.i = o.i + 1)
select conv_id, turn, round(pos, 4) as "offset" from o""",
    "turn_schedule": """with p as (select conv_id as scene, turn as phase_index, 'p' || turn as phase, (conv_id + turn) % 5 = 0 as silence, role from conversations),
e as (select scene, phase_index, phase, 0 as slot, case when silence then null else role end as speaker from p
  union all select scene, phase_index, phase, 1, 'assistant' from p where not silence),
n as (select *, row_number() over (partition by scene order by phase_index, slot) - 1 as i, max(phase_index) over (partition by scene) as last, count(*) over (partition by scene, phase_index) as size from e),
k as (select *, unnest(range(0, 10)) as round from n)
select scene, i + round * size as turn, phase, speaker from k where i + round * size < 6 and (round = 0 or phase_index = last)""",
    "ambient_remerge": """with t as (select *, case when (conv_id + turn) % 7 <> 0 then (turn * 5 % 8)::double end as time, role = 'system' as a from conversations)
select conv_id, turn, row_number() over (partition by conv_id order by time nulls last, a, turn) - 1 as position from t""",
    "speaking_rate": "select conv_id, turn, round(len(regexp_extract_all(text, '\\S+')) / nullif(length(text) / 11.0::double, 0), 6) as words_per_second from conversations",
    "wake_vocative": r"""with w as (select conv_id, turn, list_transform(regexp_extract_all(text, '\p{L}+'), lambda x: lower(x)) as w from conversations),
p as (select *, list_position(w, 'the') as k from w)
select conv_id, turn, coalesce(k > 0 and len(list_filter(w[1:k - 1], lambda x: x not in ('and', 'in', 'to', 'of', 'on', 'a', 'for', 'that'))) = 0, false) or list_contains(w[-2:], 'the') as addressed from p""",
    "confusion_by_type": f"""with {_scored()}, c as (select coalesce(trigger_type, 'overall') as bucket, {_COUNTS.format(t="0.5")}, count(*) as n from s group by rollup (trigger_type))
select *, {_RATES} from c""",
    "fa_per_hour": f"""with {_scored()}, c as (select count(*) filter (not expected and score > 0.5) as fp, {_HOURS} from s)
select fp, round(hours, 6) as hours, round(speech_hours, 6) as speech_hours, {_PER_HOUR} from c""",
    "threshold_sweep": _sweep(),
    "ensemble_sweep": _sweep(("score-v1", "score-v2", "score-v3")),
    "threshold_transfer": f"""with {_scored()}, g as (select i / 20.0::double as t from range(1, 20) r(i)),
c as (select t, {_COUNTS.format(t="t")} from s cross join g where conv_id % 2 = 0 group by t), p as (select *, {_RATES} from c),
b as (select case when max(f1) > 0 then max_by(t, struct_pack(a := f1, b := -t)) else 0.5 end as t from p),
x as (select t as threshold, {_COUNTS.format(t="t")}, count(*) as n from s cross join b where conv_id % 2 = 1 group by t)
select round(threshold, 2) as threshold, tp, fp, tn, fn, n, {_RATES} from x""",
}
