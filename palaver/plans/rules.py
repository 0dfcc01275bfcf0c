"""Queries over the rules of texts, names, phases and speakers.

Turns of the conversations stand for utterances: DECOR gives some of them labels, quotes, names
and the like, in SQL that both engines read alike.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.functions import text as tx
from palaver.operators import pages, scenario
from palaver.plans.conversations import conversations
from palaver.sources import tables

NAMES = ("Sigma", "Ann", "Bob", "Assistant", "User", "User1", "User2")
LABELS = ("Original text", "Rewritten", "Output")
MENTION, NEGATION = "(that|der|les)", "(not|nicht|in|en)"
TRAITS = {"calm": ["the", "und"], "curious": ["wh", "qu"], "terse": ["zz"], "warm": ["lich", "oi"]}
CAST = {"a0": "Ann", "a1": "Bob", "user2": "Cleo"}


def _pick(n: int, *cases: str, other: str = "text") -> str:
    return f"case (conv_id + turn) % {n} " + " ".join(f"when {i} then {c}" for i, c in enumerate(cases)) + f" else {other} end"


_SHORT = "substr(text, 1, 30)"
DECOR = {
    "quoted": _pick(8, f"concat('\"', {_SHORT}, '\"')", "concat('I ', text)", "concat('NASA ', text)", "''", "concat('  “', text)", "concat('sigma, ', text)", "'12 x'"),
    "wrapped": _pick(7, f"concat('Original text: \"', {_SHORT}, '\"')", f"concat('rewritten : ', {_SHORT})", f"concat('“', {_SHORT}, '”')", "'Output: Output: `x`'", "'\"\"'", f"concat('''Output: ', {_SHORT}, '''')"),
    "spoken": _pick(7, f"concat('Ann: ', {_SHORT})", f"concat(' bob :', {_SHORT})", f"concat('Sigma, ', {_SHORT})", f"concat('User1: Ann: ', {_SHORT})", f"concat('Assistant: Sigma: ', {_SHORT})", "'Bob,x'"),
    "nested": _pick(4, f"concat({_SHORT}, chr(10), 'Ann: yes', chr(10), 'Bob: no')", f"concat('bob : first', chr(10), {_SHORT})", f"concat({_SHORT}, chr(10), ' sigma: x')"),
    "tagged": _pick(4, "'[laughs]'", "concat('[a] ', text)", "'... !'"),
    "asr": _pick(3, "concat('It''s ', text)", "concat(text, ' x-1’s')"),
    "stamp": _pick(6, "'12.5s (note)'", "' 7s'", "'x'", "'3'", "'4.25 s'", other="concat(turn, '.5s')"),
    "prose": _pick(5, f"concat('Here: [1, 2] and [', {_SHORT}, '] end')", "'```json [1] ``` and [2]'", "'no list'", "'``` [3, 4] ```'", other="concat('[', turn, ']')"),
    "brief": _pick(5, "'Ask the voice device. Then wait.'", "'The assistant answers at once.'", "'Sigma never speaks here.'", "'No Voice Command at all, Sigma replies'"),
    "response": _pick(5, "'[silence]'", "'  '", "'yes [SILENCE]'", "null"),
}


def _u(spark, d, name: str):
    return conversations(spark, d).withColumn("x", F.expr(DECOR[name]))


def path_decode(spark, d):
    rows = tables.table(spark, d, "documents").select("doc_id", F.expr(_PATH).alias("path"))
    p = tx.path_parts(F.col("path"))
    return rows.select("doc_id", p["scenario"].alias("scenario"), p["variant"].alias("variant"), p["file"].alias("file"))


def conversation_types(spark, d):
    kind = F.when(F.col("role") == "user", "single").otherwise("couple")
    return conversations(spark, d).select("conv_id", "turn", tx.conversation_type(kind).alias("conversation_type"), tx.role_for_page(F.col("role"), "assistant", "system").alias("page_role"))


def turns_estimate(spark, d):
    n = (F.col("turn") % 4).cast("int")
    template = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.array_repeat(F.lit("x"), i).alias("speakers")))).otherwise(F.array().cast("array<struct<speakers:array<string>>>"))
    most = F.when(F.col("conv_id") % 3 != 0, (F.col("conv_id") % 9).cast("int"))
    return conversations(spark, d).select("conv_id", "turn", tx.estimated_turns(template, most).alias("estimate"))


def _variants(spark, d):
    """Parts as variations, with and without the assistant in one way or another."""
    return tables.table(spark, d, "part").selectExpr(
        "p_partkey", "p_brand as category", "concat(case when p_partkey % 3 = 0 then 'no_va_' else '' end, translate(p_name, ' ', '_')) as file",
        "case when p_partkey % 4 = 0 then concat(p_name, '_no_va') else p_name end as name", "case p_partkey % 5 when 0 then 0 when 1 then null else 8 end as max_turns",
        "case when p_size % 2 = 0 then 'Sigma' else 'Ann' end as speaker")


def silent_variants(spark, d):
    most, name, file = F.col("max_turns"), F.col("name"), F.col("file")
    return _variants(spark, d).select(
        "p_partkey", tx.is_silent_config(most, file).alias("by_config"), F.coalesce(tx.is_silent_twin(most, name, file), F.lit(False)).alias("by_twin"),
        tx.is_silent_export(F.array(F.lit("user"), "speaker"), ["Sigma", "Assistant"]).alias("by_export"))


def va_partition(spark, d):
    return scenario.partition_silent(_variants(spark, d)).groupBy("category").agg(F.count_if(~F.col("silent")).alias("with_assistant"), F.count_if("silent").alias("without"))


def twin_names(spark, d):
    return _variants(spark, d).select("p_partkey", tx.twin_path(F.concat_ws("/", "category", "file")).alias("path"), tx.twin_name(F.col("name")).alias("name"))


def missing_twins(spark, d):
    rows = _variants(spark, d).select("p_partkey", F.concat_ws("/", "category", "file").alias("path"))
    return scenario.without_twin(rows, "path").select("p_partkey", "path")


def assistant_mentions(spark, d):
    x = F.col("x")
    return _u(spark, d, "brief").select("conv_id", "turn", tx.needs_rewrite(x).alias("rewrite"), tx.says(x, tx.MENTION).alias("mentions"), tx.says(x, tx.NEGATION).alias("negated"), tx.affirms(x).alias("affirms"))


def affirmative_dropped(spark, d):
    return tables.table(spark, d, "documents").where("doc_id % 2 = 0").select("doc_id", F.md5(tx.sentences_without(F.col("text"), MENTION, NEGATION).cast("binary")).alias("kept"))


def directives_dropped(spark, d):
    rules = F.array("x", F.lit("Sigma says little."), F.lit("Keep it short."), F.lit("The assistant never helps."))
    rows = _u(spark, d, "brief").select("conv_id", "turn", rules.alias("rules")).withColumn("kept", scenario.without_directives(F.col("rules"), tx.AFFIRM, tx.NEGATION))
    return rows.select("conv_id", "turn", F.array_join("kept", "|").alias("kept"), (F.size("rules") != F.size("kept")).alias("edited"))


_PHASES = ("assistance_request ", "planning", "asking for help", "breakfast")


def phases_without_assistant(spark, d):
    name = F.element_at(F.array(*map(F.lit, _PHASES)), ((F.col("conv_id") + F.col("turn")) % 4 + 1).cast("int"))
    note = F.when(F.col("turn") % 3 == 0, "Stay calm").when(F.col("turn") % 3 == 1, "Go on! No help.")
    phase = F.struct(name.alias("phase"), F.array("role", F.lit("user")).alias("speakers"), note.alias("note"))
    rows = conversations(spark, d).select("conv_id", "turn", F.array(phase).alias("before")).withColumn("after", scenario.without_assistant(F.col("before"), "No help."))
    p = F.get("after", 0)
    return rows.select("conv_id", "turn", p["phase"].alias("phase"), F.array_join(p["speakers"], ",").alias("speakers"), p["note"].alias("note"), scenario.count_changes(F.col("before"), F.col("after")).alias("changes"))


def wake_prepended(spark, d):
    return _u(spark, d, "quoted").select("conv_id", "turn", tx.prepend_name(F.col("x"), "Sigma").alias("said"))


def wrapper_stripped(spark, d):
    return _u(spark, d, "wrapped").select("conv_id", "turn", tx.strip_wrapper(F.col("x"), LABELS, 3).alias("bare"), tx.strip_wrapper(F.col("x"), LABELS, 2, keep_if_empty=False).alias("unwrapped"))


def speaker_stripped(spark, d):
    return _u(spark, d, "spoken").select("conv_id", "turn", tx.strip_speaker(F.col("x"), NAMES, "Sigma", F.col("role") == "user").alias("bare"))


def nested_cut(spark, d):
    return _u(spark, d, "nested").select("conv_id", "turn", tx.cut_nested(F.col("x"), NAMES).alias("own"))


def speakable(spark, d):
    return _u(spark, d, "tagged").select("conv_id", "turn", tx.is_speakable(F.col("x")).alias("speakable"))


def asr_tokens(spark, d):
    words = tx.asr_tokens(F.col("x"))
    return _u(spark, d, "asr").select("conv_id", "turn", F.size(words).alias("n"), F.md5(F.array_join(words, " ").cast("binary")).alias("tokens"))


def file_names(spark, d):
    return tables.table(spark, d, "pages").select("page_id", tx.file_name(F.col("url")).alias("file"))


def seconds_parsed(spark, d):
    return _u(spark, d, "stamp").select("conv_id", "turn", tx.seconds(F.col("x")).alias("seconds"))


def json_sliced(spark, d):
    return _u(spark, d, "prose").select("conv_id", "turn", tx.json_slice(F.col("x")).alias("slice"), tx.fenced_json(F.col("x")).alias("fenced"))


def silence_flags(spark, d):
    flag = F.when(F.col("turn") % 3 == 0, True).when(F.col("turn") % 3 == 1, False)
    phase = F.when(F.col("conv_id") % 4 == 0, "Silence").when(F.col("conv_id") % 4 == 1, "talk")
    return conversations(spark, d).select("conv_id", "turn", tx.is_silence(flag, phase).alias("silence"))


_RAW = _pick(4, "'[\"user1\", {\"speaker\": \"user2\", \"interjection\": \"cut in\"}, \"assistant\"]'", "'[{\"speaker\": \"user1\", \"interjection\": \"mm\"}]'", "'[\"user2\", \"user1\"]'", other="'[]'")


def speakers_normal(spark, d):
    kind = F.when(F.col("conv_id") % 2 == 0, "single_user").otherwise("multi_user")
    rows = conversations(spark, d).select("conv_id", "turn", scenario.normal_speakers(F.expr(_RAW), kind).alias("s"))
    tags = F.transform(F.array_sort(F.map_entries("s.interjections")), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"]))
    return rows.select("conv_id", "turn", F.array_join("s.names", ",").alias("names"), F.array_join(tags, ",").alias("interjections"))


def assistant_forced(spark, d):
    phase = F.when(F.col("turn") % 3 == 0, "planning").when(F.col("turn") % 3 == 1, "discussion").otherwise("chat")
    return conversations(spark, d).select("conv_id", "turn", F.array_join(tx.add_speaker(phase, F.array("role"), "assistant"), ",").alias("speakers"))


def speaker_names(spark, d):
    cast = F.create_map(*(F.lit(x) for kv in CAST.items() for x in kv))
    agent = F.concat(F.lit("a"), (F.col("turn") % 4).cast("string"))
    return conversations(spark, d).select("conv_id", "turn", scenario.speaker_name(F.col("role"), agent, cast, "Sigma").alias("name"))


def voices_resolved(spark, d):
    m = lambda pairs: F.create_map(*(x if not isinstance(x, str) else F.lit(x) for kv in pairs for x in kv))
    characters = m([("Ann", m([("m1", "v-ann")])), ("Bob", m([("m2", "v-bob")]))])
    generic = m([("Bob", m([("calm", m([("m1", "g-bob")]))])), ("Cleo", m([("loud", m([("m1", "g-cleo")]))]))])
    who = F.element_at(F.array(*map(F.lit, ("Ann", "Bob", "Cleo", "Dan"))), (F.col("turn") % 4 + 1).cast("int"))
    mode = F.when(F.col("conv_id") % 2 == 0, "calm").otherwise("loud")
    by_place = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("p"), F.col("turn").cast("string")))
    return conversations(spark, d).select("conv_id", "turn", scenario.voice_of(who, "m1", mode, characters, generic, by_place).alias("voice"))


def voice_pool(spark, d):
    voices = tables.table(spark, d, "part").select("p_partkey", F.initcap(F.substring_index("p_name", " ", 1)).alias("name"))
    stories = tables.table(spark, d, "part").where("p_size < 10").select(F.upper(F.substring_index("p_name", " ", 1)).alias("name"))
    return scenario.pool(voices, stories)


def durations_shown(spark, d):
    return tables.table(spark, d, "documents").select("doc_id", tx.pretty_duration(F.col("n_chars") * F.lit(0.5)).alias("shown"))


def durations_resolved(spark, d):
    n = F.col("turn")
    own = F.when(n % 4 == 0, F.lit(0.0)).when(n % 4 == 1, n.cast("double"))
    config = F.when(n % 5 == 0, F.lit(0.0)).when(n % 5 == 1, F.lit(3.5))
    second = F.when(F.col("conv_id") % 2 == 0, F.lit(2.5)).otherwise(F.lit(0.0))
    return conversations(spark, d).select("conv_id", "turn", tx.resolve_duration(own, config, second).alias("seconds"))


def traits_found(spark, d):
    return tables.table(spark, d, "documents").select("doc_id", F.array_join(tx.traits(F.col("text"), TRAITS), ",").alias("traits"))


def variation_names(spark, d):
    name = F.when(F.col("p_partkey") % 3 == 0, F.lit(None)).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("x_"), F.col("p_size").cast("string"), F.lit("_y"))).otherwise(F.translate("p_name", " ", "_"))
    return tables.table(spark, d, "part").select("p_partkey", tx.variation_name(name, F.col("p_brand"), F.col("p_size")).alias("name"))


def keyword_files(spark, d):
    rows = tables.table(spark, d, "part").select("p_partkey", "p_name", "p_type")
    some = tables.files_for_scenario(rows, ["RING", "copper"], "p_name", "p_type").select("p_partkey", F.lit("some").alias("asked"))
    return some.union(tables.files_for_scenario(rows, ["no such word"], "p_name", "p_type").select("p_partkey", F.lit("none").alias("asked")))


def outcomes(spark, d):
    return _u(spark, d, "response").select("conv_id", "turn", tx.outcome(F.col("role") == "user", F.col("x")).alias("outcome"))


def distinct_speakers(spark, d):
    return scenario.distinct_speakers(conversations(spark, d)).select("conv_id", F.array_join("speakers", ",").alias("speakers"))


def eligible_categories(spark, d):
    return scenario.eligible(_variants(spark, d), "category", ["Brand#2", "Brand#4"])


def risky_names(spark, d):
    words = lambda c: F.array_distinct(F.split(F.lower(c), " "))
    return tables.table(spark, d, "part").select("p_partkey", F.array_join(scenario.risky(words(F.col("p_name")), F.array(*map(F.lit, ("ring", "bolt", "small", "red")))), ",").alias("risky"))


def variations_joined(spark, d):
    new = F.when(F.col("p_size") % 3 == 0, F.array("p_name", "p_type")).when(F.col("p_size") % 3 == 1, F.array("p_brand"))
    return tables.table(spark, d, "part").select("p_partkey", F.array_join(scenario.appended(F.array(F.lit("base")), new), "|").alias("variations"))


_FILES = "case doc_id % 4 when 0 then concat(source, '/_background_debug/f', doc_id, '.wav') when 1 then concat(source, '/f', doc_id, '.json') else concat(source, '/', lang, '/f', doc_id, '.wav') end"


def first_files(spark, d):
    return pages.first_files(tables.table(spark, d, "documents").selectExpr("source", f"{_FILES} as path"), "source", ".wav")


def voice_cards(spark, d):
    parts = tables.table(spark, d, "part").withColumn("name", F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")))
    samples = parts.select("name", F.col("p_brand").alias("voice_id"))
    listed = parts.where("p_partkey % 5 <> 0").select("name", F.when(F.col("p_partkey") % 3 == 0, "other").otherwise(F.col("p_brand")).alias("voice_id"), F.when(F.col("p_size") > 9, F.col("p_type")).alias("description"), F.lit("f").alias("gender"))
    intros = parts.where("p_partkey % 7 <> 0").select("name", F.concat(F.lit("  I am "), "p_name", F.lit(" ")).alias("text"))
    return pages.voice_cards(samples, listed, intros).select("name", "voice_id", "description", "gender", "intro", "fault")


def compared_pairs(spark, d):
    rows = tables.table(spark, d, "part").selectExpr("concat(case when p_partkey % 3 = 0 then 'no_va_' else '' end, 'scene_', p_partkey) as ours", "concat('r', p_partkey % 50) as real")
    files = rows.where("substr(ours, -1) <> '4'").selectExpr("ours as name", "length(ours) * 1.25 as duration").union(rows.where("real <> 'r9'").select("real", F.lit(7.0)).distinct())
    return pages.compared_pairs(rows, files.withColumn("duration", F.col("duration").cast("double")))


def roles_merged(spark, d):
    n = F.col("p_partkey")
    return tables.table(spark, d, "part").select("p_partkey", pages.merged_role(F.col("p_type"), F.when(n % 2 == 0, F.col("p_name")), F.when(n % 3 == 0, F.col("p_brand"))).alias("role"))


def prompts_joined(spark, d):
    x = F.col("p_size")
    return tables.table(spark, d, "part").select("p_partkey", F.md5(pages.prompt(F.col("p_name"), F.when(x % 2 == 0, "  "), F.when(x % 3 == 0, F.col("p_type")), F.lit("end")).cast("binary")).alias("prompt"))


def file_provenance(spark, d):
    files = tables.table(spark, d, "pages").select(F.col("page_id").alias("name"), F.when(F.col("page_id") % 5 != 0, F.col("html").cast("binary")).alias("content"))
    return pages.provenance(files, {"commit": "abc", "dirty": "no"})


QUERIES = {f.__name__: f for f in (
    first_files, voice_cards, compared_pairs, roles_merged, prompts_joined, file_provenance,
    path_decode, conversation_types, turns_estimate, silent_variants, va_partition, twin_names, missing_twins, assistant_mentions, affirmative_dropped, directives_dropped,
    phases_without_assistant, wake_prepended, wrapper_stripped, speaker_stripped, nested_cut, speakable, asr_tokens, file_names, seconds_parsed, json_sliced, silence_flags,
    speakers_normal, assistant_forced, speaker_names, voices_resolved, voice_pool, durations_shown, durations_resolved, traits_found, variation_names, keyword_files, outcomes,
    distinct_speakers, eligible_categories, risky_names, variations_joined,
)}

_PATH = (
    "case when doc_id % 5 = 0 then concat(source, '/f', doc_id, '.json') when doc_id % 2 = 0 then concat(source, '/', lang, '/f', doc_id, '.json') "
    "else concat('m/v1/', source, '/', lang, '/f', doc_id, '.json') end"
)
_VARIANTS = """v as (select p_partkey, p_brand as category, concat(case when p_partkey % 3 = 0 then 'no_va_' else '' end, replace(p_name, ' ', '_')) as file,
  case when p_partkey % 4 = 0 then concat(p_name, '_no_va') else p_name end as name, case p_partkey % 5 when 0 then 0 when 1 then null else 8 end as max_turns,
  case when p_size % 2 = 0 then 'Sigma' else 'Ann' end as speaker from part)"""
_TWIN = "coalesce(case when max_turns = 0 then true else (contains(name, 'no_va') or starts_with(file, 'no_va_')) and max_turns is null end, false)"


def _x(name: str) -> str:
    return f"u as (select *, {DECOR[name]} as x from conversations)"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _says(x: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({x}, {_q('(?i)' + pattern)}), false)"


def _unwrapped(rounds: int) -> str:
    """CTEs r0 to r<rounds>, each with a column x."""
    names = "|".join(LABELS)
    out = "r0 as (select conv_id, turn, trim(x) as x from u)"
    for k in range(rounds):
        out += f""",
l{k} as (select conv_id, turn, trim(regexp_replace(x, '(?i)^(?:{names})\\s*:\\s*', '')) as x from r{k}),
r{k + 1} as (select conv_id, turn, trim(case when length(x) >= 2 and x[1] in ('"', '''', '`') and x[-1] = x[1] or length(x) >= 2 and (x[1] = '“' and x[-1] = '”' or x[1] = '‘' and x[-1] = '’') then x[2:-2] else x end) as x from l{k})"""
    return out


def _bare_speaker() -> str:
    x = "x"
    for n in NAMES:
        x = f"regexp_replace({x}, '(?i)^\\s*{n}\\s*:\\s*', '')"
        comma = f"regexp_replace({x}, '(?i)^\\s*{n},\\s*', '')"
        x = f"case when role = 'user' then {x} else {comma} end" if n == "Sigma" else comma
    return x


_QUOTES = tx.QUOTES.replace("'", "''")
_KNOWN = "(?i)^\\s*(?:" + "|".join(NAMES) + ")\\s*:"
_RISK = "['ring', 'bolt', 'small', 'red']"
_RENAMED = "case " + " ".join(f"when phase = '{a}' then '{b}'" for a, b in scenario.PHASE_NAMES.items()) + f" when regexp_matches(phase, '(?i){scenario.ASSIST_WORDS}') then 'talking_it_over' else phase end"
_PARTS = "s[case when len(s) <= 3 then 1 else 3 end]"

ORACLE = {
    "path_decode": f"with p as (select doc_id, string_split({_PATH}, '/') as s from documents) select doc_id, {_PARTS} as scenario, {_PARTS.replace('1 else 3', '2 else 4')} as variant, s[-1] as file from p",
    "conversation_types": """select conv_id, turn, case when role = 'user' then 'single_user' else 'multi_user' end as conversation_type,
  case role when 'assistant' then 'assistant' when 'system' then 'ambient' else 'user' end as page_role from conversations""",
    "turns_estimate": "with n as (select *, turn % 4 as n from conversations) select conv_id, turn, coalesce(nullif(n * (n + 1) // 2, 0), case when conv_id % 3 <> 0 then conv_id % 9 end, 12) as estimate from n",
    "silent_variants": f"with {_VARIANTS} select p_partkey, coalesce(max_turns = 0, false) or starts_with(file, 'no_va_') as by_config, {_TWIN} as by_twin, speaker <> 'Sigma' as by_export from v",
    "va_partition": f"with {_VARIANTS} select category, count(*) filter (not {_TWIN}) as with_assistant, count(*) filter ({_TWIN}) as without from v group by 1",
    "twin_names": f"with {_VARIANTS} select p_partkey, category || '/no_va_' || file as path, case when ends_with(name, '_no_va') then name else name || '_no_va' end as name from v",
    "missing_twins": f"with {_VARIANTS}, p as (select p_partkey, category, file, category || '/' || file as path from v) select p_partkey, path from p where category || '/no_va_' || file not in (select path from p)",
    "assistant_mentions": f"""with {_x("brief")} select conv_id, turn, {_says("x", tx.BRIEF_MENTION)} as rewrite, {_says("x", tx.MENTION)} as mentions, {_says("x", tx.NEGATION)} as negated,
  {_says("x", tx.AFFIRM)} and not {_says("x", tx.NEGATION)} as affirms from u""",
    "affirmative_dropped": f"""with s as (select doc_id, string_split(regexp_replace(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\s{{2,}}', chr(1), 'g'), chr(1)) as s from documents where doc_id % 2 = 0)
select doc_id, md5(trim(array_to_string(list_filter(s, lambda x: not (regexp_matches(x, '(?i){MENTION}') and not regexp_matches(x, '(?i){NEGATION}')) and trim(x) <> ''), ' '))) as kept from s""",
    "directives_dropped": f"""with {_x("brief")}, r as (select conv_id, turn, [x, 'Sigma says little.', 'Keep it short.', 'The assistant never helps.'] as rules from u),
k as (select *, list_filter(rules, lambda y: not ({_says("y", tx.AFFIRM)} and not {_says("y", tx.NEGATION)})) as kept from r)
select conv_id, turn, array_to_string(kept, '|') as kept, len(kept) <> len(rules) as edited from k""",
    "phases_without_assistant": f"""with p as (select conv_id, turn, role, {list(_PHASES)}[(conv_id + turn) % 4 + 1] as phase, case turn % 3 when 0 then 'Stay calm' when 1 then 'Go on! No help.' end as note from conversations),
a as (select *, {_RENAMED} as renamed, array_to_string(list_filter([role, 'user'], lambda s: not contains(lower(s), 'assistant')), ',') as speakers,
  case when note is null then 'No help.' when contains(note, 'No help.') then note else note || '. No help.' end as guarded from p)
select conv_id, turn, renamed as phase, speakers, guarded as note, case when renamed is distinct from phase or guarded is distinct from note or role = 'assistant' then 1 else 0 end as changes from a""",
    "wake_prepended": f"""with {_x("quoted")}, b as (select conv_id, turn, regexp_replace(x, '^\\s+|\\s+$', '', 'g') as b from u),
s as (select conv_id, turn, regexp_replace(regexp_extract(b, '^((?:[{_QUOTES}]\\s*)*)', 1), '\\s', '', 'g') as lead, regexp_replace(b, '^(?:[{_QUOTES}]\\s*)+', '') as rest from b),
h as (select *, regexp_extract(rest, '\\p{{L}}+') as head from s)
select conv_id, turn, case when rest = '' then lead || 'Sigma?' else lead || 'Sigma, ' || case
  when head = 'I' or head = upper(head) and head <> lower(head) or head[2:] <> lower(head[2:]) or lower(head) = 'sigma' or not regexp_matches(rest[1], '\\p{{L}}') then rest else lower(rest[1]) || rest[2:] end end as said from h""",
    "wrapper_stripped": f"""with {_x("wrapped")}, {_unwrapped(3)}
select r0.conv_id, r0.turn, case when r3.x = '' then r0.x else r3.x end as bare, r2.x as unwrapped from r0 join r2 using (conv_id, turn) join r3 using (conv_id, turn)""",
    "speaker_stripped": f"with {_x('spoken')} select conv_id, turn, {_bare_speaker()} as bare from u",
    "nested_cut": f"""with {_x("nested")}, l as (select conv_id, turn, string_split(x, chr(10)) as l from u),
p as (select *, list_position(list_transform(l, lambda y: regexp_matches(y, '{_KNOWN}')), true) as k from l) select conv_id, turn, trim(array_to_string(case when k > 0 then l[1:k - 1] else l end, chr(10))) as own from p""",
    "speakable": f"with {_x('tagged')} select conv_id, turn, regexp_matches(regexp_replace(x, '\\[[^\\]]*\\]', '', 'g'), '[\\p{{L}}\\p{{N}}]') as speakable from u",
    "asr_tokens": f"""with {_x("asr")}, t as (select conv_id, turn, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(x), '[''’]', '', 'g'), '[^a-z0-9 ]', ' ', 'g'), '\\s+'), lambda y: y <> '') as t from u)
select conv_id, turn, len(t) as n, md5(array_to_string(t, ' ')) as tokens from t""",
    "file_names": "select page_id, regexp_replace(url, '[^\\p{L}\\p{N}_-]', '_', 'g') as file from pages",
    "seconds_parsed": f"with {_x('stamp')} select conv_id, turn, try_cast(regexp_replace(trim(regexp_replace(x, '\\(.*\\)', '')), 's$', '') as double) as seconds from u",
    "json_sliced": f"""with {_x("prose")}, j as (select conv_id, turn, nullif(regexp_extract(x, '(?s)(\\[.*\\])', 1), '') as slice, nullif(regexp_extract(x, '(?s)```(?:json)?\\s*(\\[.*?\\])\\s*```', 1), '') as f from u)
select conv_id, turn, slice, coalesce(f, slice) as fenced from j""",
    "silence_flags": "select conv_id, turn, turn % 3 = 0 or conv_id % 4 = 0 as silence from conversations",
    "speakers_normal": f"""with r as (select conv_id, turn, cast({_RAW} as json) as raw from conversations),
i as (select conv_id, turn, x.i, coalesce(case when json_type(x.v) = 'OBJECT' then x.v->>'$.speaker' end, x.v->>'$') as name, case when json_type(x.v) = 'OBJECT' then x.v->>'$.interjection' end as tag
  from (select conv_id, turn, unnest(list_transform(range(0, json_array_length(raw)::bigint), lambda i: struct_pack(i := i, v := json_extract(raw, '$[' || i || ']')))) as x from r)),
k as (select *, row_number() over (partition by conv_id, turn order by i) - 1 as n from i where not (conv_id % 2 = 0 and name = 'user2'))
select c.conv_id, c.turn, coalesce(string_agg(name, ',' order by n), '') as names, coalesce(string_agg(n || '=' || tag, ',' order by n) filter (tag is not null), '') as interjections
from conversations c left join k using (conv_id, turn) group by all""",
    "assistant_forced": "select conv_id, turn, role || case when turn % 3 <> 2 and role <> 'assistant' then ',assistant' else '' end as speakers from conversations",
    "speaker_names": "select conv_id, turn, case when role = 'assistant' then 'Sigma' when turn % 4 = 0 then 'Ann' when turn % 4 = 1 then 'Bob' else 'Cleo' end as name from conversations",
    "voices_resolved": """with w as (select conv_id, turn, ['Ann', 'Bob', 'Cleo', 'Dan'][turn % 4 + 1] as who, case when conv_id % 3 = 0 then 'p' || turn end as place from conversations)
select conv_id, turn, case when who = 'Ann' then 'v-ann' when who = 'Bob' and conv_id % 2 = 0 then 'g-bob' when who = 'Cleo' and conv_id % 2 = 1 then 'g-cleo' else place end as voice from w""",
    "voice_pool": """with w as (select p_partkey, split_part(p_name, ' ', 1) as w, p_size from part)
select p_partkey, upper(w[1]) || lower(w[2:]) as name from w where lower(w) in (select lower(w) from w where p_size < 10)""",
    "durations_shown": """with s as (select doc_id, n_chars * 0.5::double as s from documents), p as (select doc_id, floor(s / 3600)::bigint as h, floor((s % 3600) / 60)::bigint as m, s % 60 as r from s)
select doc_id, case when h > 0 then printf('%dh %dm %.1fs', h, m, r) when m > 0 then printf('%dm %.1fs', m, r) else printf('%.1fs', r) end as shown from p""",
    "durations_resolved": """select conv_id, turn, coalesce(case turn % 4 when 0 then 0::double when 1 then turn::double end, case when turn % 5 = 1 then 3.5::double end, case when conv_id % 2 = 0 then 2.5::double end, 8::double) as seconds from conversations""",
    "traits_found": "select doc_id, array_to_string(list_filter([" + ", ".join(f"case when {' or '.join(f'contains(lower(text), {_q(k)})' for k in ks)} then '{n}' end" for n, ks in sorted(TRAITS.items())) + "], lambda t: t is not null), ',') as traits from documents",
    "variation_names": """with n as (select p_partkey, p_brand, '_' || p_size as tag, case p_partkey % 3 when 1 then 'x_' || p_size || '_y' when 2 then replace(p_name, ' ', '_') end as name from part)
select p_partkey, case when name is null then p_brand || tag when contains(name, tag) then name else name || tag end as name from n""",
    "keyword_files": """with m as (select p_partkey, contains(lower(p_name), 'ring') or contains(lower(p_type), 'ring') or contains(lower(p_name), 'copper') or contains(lower(p_type), 'copper') as hit from part)
select p_partkey, 'some' as asked from m where hit or not (select bool_or(hit) from m) union all select p_partkey, 'none' from part""",
    "outcomes": f"""with {_x("response")}, h as (select conv_id, turn, role = 'user' as e, trim(coalesce(x, '')) <> '' and not contains(upper(coalesce(x, '')), '[SILENCE]') as hit from u)
select conv_id, turn, case when e and hit then 'TP' when e then 'FN' when hit then 'FP' else 'TN' end as outcome from h""",
    "distinct_speakers": "select conv_id, string_agg(distinct role, ',' order by role) as speakers from conversations where coalesce(role, '') <> '' group by 1",
    "eligible_categories": "select distinct p_brand as category from part where p_brand not in ('Brand#2', 'Brand#4')",
    "risky_names": f"select p_partkey, array_to_string(list_filter(w, lambda x: list_contains({_RISK}, x)), ',') as risky from (select p_partkey, string_split(lower(p_name), ' ') as w from part)",
    "variations_joined": "select p_partkey, 'base' || case p_size % 3 when 0 then '|' || p_name || '|' || p_type when 1 then '|' || p_brand else '' end as variations from part",
    "first_files": f"with f as (select source, {_FILES} as path from documents) select source, min(path) as path from f where ends_with(path, '.wav') and not contains(path, '/_background_debug/') group by 1",
    "voice_cards": """select p_name || ' ' || p_partkey as name, p_brand as voice_id, case when p_partkey % 5 <> 0 and p_size > 9 then p_type else '' end as description, case when p_partkey % 5 <> 0 then 'f' else '' end as gender,
  case when p_partkey % 7 <> 0 then 'I am ' || p_name end as intro, case when p_partkey % 7 = 0 then 'no intro' when p_partkey % 5 = 0 or p_partkey % 3 = 0 then 'voice differs' end as fault from part""",
    "compared_pairs": """with p as (select case when p_partkey % 3 = 0 then 'no_va_' else '' end || 'scene_' || p_partkey as ours, 'r' || (p_partkey % 50) as real, 'scene ' || p_partkey as label from part)
select ours, real, label, case when ours[-1] <> '4' then round(length(ours) * 1.25::double, 1) end as ours_seconds, case when real <> 'r9' then 7::double end as real_seconds, ours[-1] <> '4' and real <> 'r9' as complete from p""",
    "roles_merged": "select p_partkey, case when p_partkey % 2 = 0 then p_name else p_type end || case when p_partkey % 3 = 0 then ' ' || p_brand else '' end as role from part",
    "prompts_joined": "select p_partkey, md5(p_name || chr(10) || chr(10) || case when p_size % 3 = 0 then p_type || chr(10) || chr(10) else '' end || 'end') as prompt from part",
    "file_provenance": "select page_id as name, case when page_id % 5 <> 0 then strlen(html) end as bytes, case when page_id % 5 <> 0 then sha256(html) end as sha256, 'abc' as commit, 'no' as dirty from pages",
}
