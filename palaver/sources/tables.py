"""Readers and writers: tables, nested JSON trees, side files, audio, and their sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from palaver.functions import text as tx

MESSAGE = "speaker string, content string, time double, interjection string, duration double, audio_path string"
CONVERSATION = f"scenario_type string, conversation_type string, context string, variant_type string, variant_name string, conversation array<struct<{MESSAGE.replace(' string', ':string').replace(' double', ':double')}>>, _corrupt_record string"
PHASE = "struct<phase:string,topic:string,speakers:array<string>,mood:string,note:string,silence:boolean,duration:double>"
SCENARIO = (
    "name string, initial_prompt string, default_characters map<string,map<string,struct<name:string,backstory:string,backstory_file:string,tts_prompt:string>>>, "
    f"variations array<struct<variant_name:string,context:string,scenario_template:array<{PHASE}>,complexity:string,min_turns:int,max_turns:int,max_words_per_turn:int,default_characters:string>>, _corrupt_record string"
)
EXCLUDED = ("validation", ".history", "corpora_version.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def relative(root: str, file: Column | None = None) -> Column:
    """The part of the file's path below root."""
    bare = root.rstrip("/").split("://")[-1].removeprefix("file:")
    path = F.url_decode(F.regexp_replace(F.col("_metadata.file_path") if file is None else file, r"\+", "%2B"))
    return F.regexp_replace(F.regexp_replace(path, "^file:/+", "/"), rf"^.*?\Q{bare}\E/", "")


def scan_json(spark: SparkSession, root: str, schema: str, excluded=EXCLUDED) -> DataFrame:
    """One row per JSON file below root, path added; files that do not parse keep their text in _corrupt_record.

    Empty files give no row here; malformed_files() finds them.
    """
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(root)
    rows = rows.withColumn("path", relative(root))
    for part in excluded:
        rows = rows.where(~F.contains(F.col("path"), F.lit(part)))
    return rows


def malformed_files(spark: SparkSession, root: str, excluded=EXCLUDED) -> DataFrame:
    """Paths of JSON files that hold nothing or do not parse.

    Spark's scans pass over files of no bytes: what is listed but not read is one of those. The
    listing is Spark's own, done once for the scan.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(root)
    listed = spark.createDataFrame([(f,) for f in files.inputFiles()], "file string").select(relative(root, F.col("file")).alias("path"))
    text = F.col("content").cast("string")
    bad = F.try_parse_json(text).isNull() | ~text.rlike(r"\S")
    read = files.select(relative(root).alias("path"), bad.alias("bad"))
    files = listed.join(read, "path", "left").where("bad or bad is null").select("path")
    for part in excluded:
        files = files.where(~F.contains(F.col("path"), F.lit(part)))
    return files


def conversation_turns(files: DataFrame) -> DataFrame:
    """Files of conversations to one row per turn: conv_id (the path), turn, role, text, time."""
    rows = files.where("_corrupt_record is null").select("path", F.posexplode("conversation").alias("turn", "t"))
    return rows.select(F.col("path").alias("conv_id"), F.col("turn").cast("long"), F.col("t.speaker").alias("role"), F.col("t.content").alias("text"), F.col("t.time").alias("time"))


def scan_variations(spark: SparkSession, root: str, min_depth: int = 3) -> DataFrame:
    """One row per variation of the scenario configs at least min_depth deep."""
    files = scan_json(spark, root, SCENARIO).where("_corrupt_record is null").where(F.size(F.split("path", "/")) >= min_depth)
    parts = F.split("path", "/")
    rows = files.select(F.get(parts, 0).alias("category"), F.get(parts, 1).alias("variant_type"), F.regexp_replace(F.element_at(parts, -1), r"\.json$", "").alias("stem"), "path", F.posexplode("variations").alias("i", "v"))
    out = rows.select("category", "variant_type", "stem", "path", "i", "v.*")
    return out.withColumns({
        "turns": tx.estimated_turns(F.col("scenario_template"), F.col("max_turns")),
        "no_va": tx.is_silent_config(F.col("max_turns"), F.col("stem")),
        "group_key": tx.group_key(F.col("category"), F.col("variant_type"), F.col("stem")),
    })


def scan_slots(spark: SparkSession, root: str, block: str) -> DataFrame:
    """Role slots of one block of default characters; only those with a backstory file."""
    files = scan_json(spark, root, SCENARIO).where("_corrupt_record is null")
    rows = files.select("path", F.explode(F.map_entries(F.element_at("default_characters", block))).alias("e"))
    return rows.select("path", F.col("e.key").alias("slot"), "e.value.*").where("backstory_file is not null")


def find_variants(variations: DataFrame, variant: str | None = None, conversation_type: str | None = None) -> DataFrame:
    """Variations of one variant and conversation type; None takes all."""
    kinds = {"single_user": "single", "multi_user": "couple", "background_noise": "couple"}
    if variant is not None:
        variations = variations.where(F.col("variant_name") == variant)
    if conversation_type is not None:
        variations = variations.where(F.col("variant_type") == kinds[conversation_type])
    return variations


def only_missing(wanted: DataFrame, outputs: DataFrame, key: str, skip_long: bool = False) -> DataFrame:
    """What has no output yet; with skip_long, without the `_long` takes."""
    rows = wanted.where(~F.col(key).endswith("_long")) if skip_long else wanted
    return rows.join(outputs.select(key), key, "left_anti")


def files_for_scenario(files: DataFrame, keywords, *texts: str) -> DataFrame:
    """Files whose texts hold a keyword; all of them if none does."""
    marked = files.withColumn("_hit", tx.matches_keywords(keywords, *map(F.col, texts)))
    some = marked.agg(F.coalesce(F.bool_or("_hit"), F.lit(False)).alias("_some"))
    return marked.join(F.broadcast(some), F.lit(True)).where("_hit or not _some").drop("_hit", "_some")


def config_index(spark: SparkSession, root: str) -> DataFrame:
    """key to config: stems and variation names; the first in path order wins, a stem before its names."""
    rows = scan_json(spark, root, SCENARIO).where("_corrupt_record is null")
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.json$", "")
    keys = rows.select("path", F.posexplode(F.concat(F.array(stem), F.coalesce(F.col("variations.variant_name"), F.array().cast("array<string>")))).alias("rank", "key")).where("key is not null")
    order = Window.partitionBy("key").orderBy("path", "rank")
    return keys.withColumn("n", F.row_number().over(order)).where("n = 1").select("key", "path")


def scenario_catalog(spark: SparkSession, root: str) -> DataFrame:
    """name_variant and name to config; the last in path order wins."""
    rows = scan_json(spark, root, SCENARIO).where("_corrupt_record is null")
    keys = F.concat(F.array("name"), F.transform(F.col("variations.variant_name"), lambda v: F.concat(F.col("name"), F.lit("_"), v)))
    return rows.select(F.explode(keys).alias("key"), "path").where("key is not null").groupBy("key").agg(F.max("path").alias("path"))


def onset_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """key, onsets of the sidecar's sessions."""
    rows = spark.read.schema("sessions map<string,struct<onsets:array<double>>>").option("multiLine", True).json(path)
    return rows.select(F.explode("sessions").alias("key", "v")).select("key", "v.onsets")


def split_manifest(spark: SparkSession, path: str) -> DataFrame:
    """group_key, split, with the manifest's seed and ratios on every row."""
    rows = spark.read.schema("seed string, ratios array<double>, groups map<string,string>").option("multiLine", True).json(path)
    return rows.select("seed", "ratios", F.explode("groups").alias("group_key", "split"))


def text_folder(spark: SparkSession, root: str) -> DataFrame:
    """stem, text of each text file."""
    rows = spark.read.text(root, wholetext=True, pathGlobFilter="*.txt", recursiveFileLookup=True)
    return rows.select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.txt$", 1).alias("stem"), F.col("value").alias("text"))


def key_values(spark: SparkSession, path: str) -> DataFrame:
    """key, value of KEY=VALUE lines; blank and # lines are passed over, quotes around a value removed."""
    rows = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' and not startswith(line, '#') and contains(line, '=')")
    value = F.regexp_replace(F.trim(F.expr("substring(line, instr(line, '=') + 1)")), "^([\"'])(.*)\\1$", "$2")
    return rows.select(F.trim(F.substring_index("line", "=", 1)).alias("key"), value.alias("value"))


def feature_tables(spark: SparkSession, paths: dict[str, str], schema: str) -> DataFrame:
    """Feature CSVs of several systems, one below the other, with a column system."""
    out = None
    for system, path in paths.items():
        rows = spark.read.schema(schema).option("header", True).option("nanValue", "nan").csv(path).withColumn("system", F.lit(system))
        out = rows if out is None else out.unionByName(rows)
    return out


def resume_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Earlier results; a file of another form, or none, gives no rows."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema + ", _corrupt_record string").option("multiLine", True).json(path)
    return rows.where("_corrupt_record is null and id is not null").drop("_corrupt_record")


def wanted_rows(rows: DataFrame, category: str | None = None, ids=None, has_va: bool | None = None, limit: int | None = None) -> DataFrame:
    """A scan with its filters; all but the limit reach the Parquet reader."""
    if category is not None:
        rows = rows.where(F.col("category") == category)
    if ids is not None:
        rows = rows.where(F.col("id").isin(list(ids)))
    if has_va is not None:
        rows = rows.where(F.col("has_va") == has_va)
    return rows if limit is None else rows.orderBy("id").limit(limit)


def first_texts(rows: DataFrame, speakers: int, texts: int) -> DataFrame:
    """Stream-like subset: the first `texts` distinct texts of the `speakers` speakers that are complete first.

    rows: speaker, text_id, position, path; only files of the first microphone.
    """
    rows = rows.where(F.contains(F.col("path"), F.lit("_mic1")))
    once = rows.withColumn("k", F.row_number().over(Window.partitionBy("speaker", "text_id").orderBy("position"))).where("k = 1")
    some = once.withColumn("n", F.row_number().over(Window.partitionBy("speaker").orderBy("position"))).where(F.col("n") <= texts)
    done = some.groupBy("speaker").agg(F.count("*").alias("c"), F.max("position").alias("done")).where(F.col("c") == texts).orderBy("done").limit(speakers)
    return some.join(F.broadcast(done.select("speaker")), "speaker", "left_semi").drop("k", "n")


def first_clip(rows: DataFrame, speakers: int, least: float, most: float) -> DataFrame:
    """The first clip of acceptable length of each of the first `speakers` speakers."""
    ok = rows.where(F.col("duration").between(least, most))
    one = ok.withColumn("k", F.row_number().over(Window.partitionBy("speaker").orderBy("position"))).where("k = 1").drop("k")
    return one.orderBy("position").limit(speakers)


def publish(rows: DataFrame, path: str, per_file: int = 100_000) -> None:
    """Parquet by split; refuses duplicate ids and rows whose times are not recovered."""
    twice = rows.groupBy("id").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"duplicate ids: {[r['id'] for r in twice]}")
    if "times_recovered" in rows.columns:
        if rows.where(~F.coalesce("times_recovered", F.lit(False))).limit(1).count():
            raise ValueError("turn times of some rows are not recovered")
        rows = rows.drop("times_recovered")
    rows.write.partitionBy("split").option("maxRecordsPerFile", per_file).parquet(path)


def write_manifest(rows: DataFrame, path: str, seed: str, ratios) -> None:
    """group_key, split as one JSON document, groups in order of their key.

    A manifest is one file for people and tools to read: its size is the number of groups.
    """
    entries = F.array_sort(F.collect_list(F.struct("group_key", "split")))
    doc = rows.select("group_key", "split").distinct().agg(F.map_from_entries(entries).alias("groups"))
    doc.select(F.to_json(F.struct(F.lit(seed).alias("seed"), F.array(*map(F.lit, ratios)).alias("ratios"), "groups")).alias("value")).coalesce(1).write.text(path)


def write_variations(variations: DataFrame, manifest: DataFrame, path: str) -> None:
    """The manifest's variations (category, variant_type, name, group_key) with their split, by category and name, as JSON lines."""
    rows = variations.join(manifest.select("group_key", "split"), "group_key", "left").orderBy("category", "name")
    rows.select(F.to_json(F.struct("category", "variant_type", "name", "group_key", "split")).alias("value")).write.text(path)


def text_manifest(metrics: DataFrame, errors: DataFrame, key: str = "scenario") -> DataFrame:
    """One row per scenario: its metrics and its number of errors, 0 without any."""
    counted = errors.groupBy(key).agg(F.count("*").alias("errors"))
    return metrics.join(counted, key, "left").withColumn("errors", F.coalesce("errors", F.lit(0)))


def load_split(spark: SparkSession, repo: str, revision: str = "main", split: str = "train") -> DataFrame:
    """Rows of one split of one revision of a published dataset; the split prunes its folder."""
    return spark.read.parquet(f"{repo.rstrip('/')}/{revision}").where(F.col("split") == split)


def ratings_table(spark: SparkSession, path: str) -> DataFrame:
    """Ratings of a study; a score that is no number is null."""
    schema = "participant_id string, stimulus_id string, dimension string, corpus string, score double, scenario string, duration double"
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def write_report(report: DataFrame, path: str) -> None:
    report.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.text(path)


def write_ledger(snapshot: DataFrame, root: str, version: str) -> None:
    """A new snapshot folder, then the history: readers take the newest complete snapshot.

    The folder appears under its name only when whole, so a reader or a second writer never meets a part of it.
    """
    spark = snapshot.sparkSession
    part, whole = (spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{x}") for x in (f".part-{version}", f"snapshots/{version}"))
    store = part.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(whole):
        raise FileExistsError(f"snapshot {version} is there already")
    snapshot.write.mode("overwrite").parquet(part.toString())
    store.mkdirs(whole.getParent())
    if not store.rename(part, whole):
        raise FileExistsError(f"snapshot {version} could not take its place")
    snapshot.withColumn("version", F.lit(version)).write.mode("append").parquet(f"{root}/history")


def read_ledger(spark: SparkSession, root: str) -> DataFrame:
    """The newest complete snapshot, by name."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/snapshots")
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [s.getPath().toString() for s in store.listStatus(where) if store.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    if not done:
        raise FileNotFoundError(f"{root} has no complete snapshot")
    return spark.read.parquet(max(done))


def merge_cache(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new take the place of rows of old with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).csv(path)
