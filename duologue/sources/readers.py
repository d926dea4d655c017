"""Readers for the JSON record files, with explicit schemas (no inference pass)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duologue.operators.rules import reader_category
from duologue.operators.ordering import custom_order

# A text column that may hold a JSON list is read as text and parsed later.
RAW_PROFILE = ("struct<pk:string,first_name:string,last_name:string,age:int,gender:string,gender_identity:string,"
               "occupation:string,big_five:string,moral_values:string,schwartz_personal_values:string,"
               "decision_making_style:string,secret:string,mbti:string,public_info:string>")
SEED_SCHEMA = (f"env_pk string, codename string, source string, scenario string, agent_goals array<string>, "
               f"relationship_type string, relationship_label string, relationship_background string, "
               f"agent_profiles array<{RAW_PROFILE}>, scenario_title string, social_dynamic string, target_perspective string")
GOAL = "struct<outcome:string,constraint:string,shortcut:string>"
KEY = ("struct<key_mechanism:string,movement_conditions:array<string>,hardening_triggers:array<string>,"
       "surface_misdirection:string,cost_coupling:string>")
PROBE_SCHEMA = (f"id string, scenario string, agent_profiles array<struct<name:string,age:int,gender_identity:string,"
                f"occupation:string,big_five:string,secret:string>>, agent_goals array<string>, structured_goals array<{GOAL}>, "
                f"interaction_type string, relationship string, relationship_background string, target_agent_idx int, "
                f"partner_key {KEY}, _format_doc string")
SCENARIO = ("struct<id:string,iteration:int,scenario:string,agent_goals:array<string>,relationship:string,"
            "interaction_type:string,source:string,source_scenario_id:string,source_env_id:string,embedding:array<float>,"
            "parent_example_ids:array<string>,target_agent_idx:int,n_i:double,prior_alpha:double,prior_beta:double,"
            "alpha_votes:double,beta_votes:double,lp_value:double,terminal_success:boolean,classification:string,"
            "mutation_operator:string,parent_id:string,root_seed_env_pk:string,lineage_depth:int,ancestor_ids:array<string>>")
ARCHIVE_SCHEMA = (f"tasks array<{SCENARIO}>, successful array<{SCENARIO}>, failed_interestingness array<{SCENARIO}>, "
                  f"failed_tasks array<{SCENARIO}>, failed_generation array<map<string,string>>, niche_counts map<string,bigint>")
SCORES = ("struct<believability:double,relationship:double,knowledge:double,secret:double,social_rules:double,"
          "financial_and_material_benefits:double,goal:double>")
TURNS = "array<struct<turn:int,speaker:string,content:string>>"
EPISODE_SCHEMA = (f"scenario_id string, source_env_id string, source string, interaction_type string, scenario string, "
                  f"learner_goal string, scores {SCORES}, goal_achieved boolean, terminal_success boolean, num_turns int, "
                  f"evaluation_reasoning string, transcript {TURNS}, error string, seed_idx int")
CHECK = ("struct<conditions_met:array<bigint>,triggers_tripped:array<bigint>,triggers_repaired:array<bigint>,"
         "key_check_passed:boolean,rationale:string>")
BANK_SCHEMA = (f"id string, scenario string, learner_goal string, status string, classification string, terminal_success boolean, "
               f"scenario_title string, attempts array<struct<attempt:int,transcript:{TURNS},scores:{SCORES},solved:boolean,"
               f"key_check_result:{CHECK},reflexion:string>>, lp_improved_votes int, n_error_votes int")


PROFILES = ("array<struct<first_name:string,last_name:string,age:int,gender_identity:string,occupation:string,big_five:string,"
            "moral_values:string,schwartz_portrait_value:string,decision_making_style:string,secret:string,mbti:string,"
            "public_info:string>>")


def _or_empty(spark: SparkSession, schema: str, read) -> DataFrame:
    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def _list_text(c: Column) -> Column:
    """A list becomes comma text, text stays."""
    items = F.from_json(c, "array<string>")
    return F.coalesce(F.when(F.startswith(c, F.lit("[")), F.array_join(items, ", ")), c, F.lit(""))


def _profile(p: Column) -> Column:
    def text(name):
        return F.coalesce(p[name], F.lit(""))

    return F.struct(
        F.coalesce(F.nullif(p["first_name"], F.lit("")), F.lit("Unknown")).alias("first_name"), text("last_name").alias("last_name"),
        F.coalesce(p["age"], F.lit(0)).alias("age"),
        F.coalesce(F.nullif(p["gender"], F.lit("")), p["gender_identity"], F.lit("")).alias("gender_identity"),
        text("occupation").alias("occupation"), text("big_five").alias("big_five"),
        _list_text(p["moral_values"]).alias("moral_values"), _list_text(p["schwartz_personal_values"]).alias("schwartz_portrait_value"),
        text("decision_making_style").alias("decision_making_style"), text("secret").alias("secret"), text("mbti").alias("mbti"),
        text("public_info").alias("public_info"))


def _blank_profile(n: int) -> Column:
    empty = ["last_name", "age", "gender_identity", "occupation", "big_five", "moral_values", "schwartz_portrait_value",
             "decision_making_style", "secret", "mbti", "public_info"]
    return F.struct(F.lit(f"Agent{n}").alias("first_name"), *[(F.lit(0) if e == "age" else F.lit("")).alias(e) for e in empty])


def in_file_order(scan: DataFrame, out: str) -> DataFrame:
    """1-based position of each row of a file scan by file name, place of the block in the file, and place in the block.

    One row for each (file, block) is counted and its offset is joined back; rows are not moved.
    """
    at = F.monotonically_increasing_id()
    marked = scan.select("*", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b"), at.alias("__m"))
    sizes = marked.groupBy("__f", "__b").agg(F.count(F.lit(1)).alias("__n"), F.min("__m").alias("__m0"))
    w = Window.orderBy("__f", "__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__f", "__b", "__m0", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    return marked.join(offsets, ["__f", "__b"]).withColumn(out, F.col("__off") + F.col("__m") - F.col("__m0") + 1).drop(
        "__f", "__b", "__m", "__m0", "__off")


def read_seeds(spark: SparkSession, path: str, limit: int | None = None, both_perspectives: bool = True) -> DataFrame:
    """A1: seed rows, one output row for each perspective; ``limit`` counts rows in the order of file names and lines.

    Rows are numbered only where that is needed: for a limit, or where a row has no key of its own.
    """
    raw = spark.read.schema(SEED_SCHEMA).json(path)
    if limit is not None or not raw.where(F.col("env_pk").isNull()).isEmpty():
        raw = in_file_order(raw, "__row")
    else:
        raw = raw.withColumn("__row", F.lit(None).cast("bigint"))
    raw = raw.withColumn("__made", F.transform(F.coalesce("agent_profiles", F.array().cast(f"array<{RAW_PROFILE}>")), _profile).cast(PROFILES))
    if limit is not None:
        raw = raw.where(F.col("__row") <= limit)
    made = F.col("__made")
    blank = F.array(_blank_profile(1), _blank_profile(2)).cast(PROFILES)
    padded = F.concat(made, F.slice(blank, F.least(F.size(made), F.lit(1)) + 1, F.greatest(2 - F.size(made), F.lit(0))))
    goals = F.slice(F.concat(F.coalesce("agent_goals", F.array().cast("array<string>")), F.array(F.lit(""), F.lit(""))), 1, 2)

    def first_text(*names):
        return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names], F.lit(""))

    env = F.coalesce("env_pk", F.concat(F.lit("seed_"), F.col("__row").cast("string")))
    sides = F.array(F.lit(0), F.lit(1)) if both_perspectives else F.array(F.lit(0))
    base = raw.select(
        env.alias("env"), F.lit(-1).alias("iteration"), F.coalesce("scenario", F.lit("")).alias("scenario"),
        padded.alias("agent_profiles"), goals.alias("agent_goals"),
        first_text("relationship_label", "relationship_type").alias("relationship"),
        F.coalesce("relationship_background", F.lit("")).alias("relationship_background"),
        first_text("codename", "source").alias("tag"), F.coalesce("source", F.lit("")).alias("interaction_type"),
        "scenario_title", "social_dynamic", "target_perspective", F.explode(sides).alias("target_agent_idx"))
    return base.select(F.concat("env", F.lit("_p"), F.col("target_agent_idx").cast("string")).alias("id"),
                       F.col("env").alias("source_env_id"), F.col("env").alias("source_scenario_id"), *base.columns[1:])


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    """A2: probe rows; blank lines, ``#`` comments and format rows are skipped, full names are split."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where((F.col("v") != "") & ~F.startswith("v", F.lit("#")))
    doc = F.array_contains(F.coalesce(F.json_object_keys("v"), F.array().cast("array<string>")), "_format_doc")
    p = lines.select(F.from_json("v", PROBE_SCHEMA).alias("p"), F.sha2("v", 256).alias("__d"), doc.alias("doc")).where("not doc").select("p.*", "__d")
    # A probe without an id is named after its content, so that it keeps its name when files are joined or cut.
    p = p.withColumn("id", F.coalesce(F.nullif("id", F.lit("")), F.concat(F.lit("probe_"), F.left("__d", F.lit(12))))).drop("__d")

    def person(x):
        parts = F.split(F.trim(F.coalesce(x["name"], F.lit("Agent"))), r"\s+", 2)
        return F.struct(parts[0].alias("first_name"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("last_name"),
                        F.coalesce(x["age"], F.lit(0)).alias("age"), F.coalesce(x["occupation"], F.lit("")).alias("occupation"),
                        F.coalesce(x["big_five"], F.lit("")).alias("big_five"))

    return p.withColumn("agent_profiles", F.transform("agent_profiles", person)).withColumn(
        "relationship", F.coalesce("relationship", F.lit("acquaintance"))).withColumn(
        "target_agent_idx", F.coalesce("target_agent_idx", F.lit(0))).withColumn("source", F.lit("probe")).drop("_format_doc")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """A3: archive rows with their bucket. Old files keep the main list under another key; a missing file is empty.

    A checkpoint is one JSON object, so one task parses a file; many files are read side by side.
    """
    schema = _flat("struct<bucket:string," + SCENARIO[len("struct<"):])
    if not path.endswith((".json", ".jsonl")):
        return spark.createDataFrame([], schema)

    def read() -> DataFrame:
        if path.endswith(".jsonl"):
            return spark.read.schema(_flat(SCENARIO)).json(path).select(F.lit("tasks").alias("bucket"), "*")
        raw = spark.read.schema(ARCHIVE_SCHEMA).option("multiLine", True).json(path)
        raw = raw.withColumn("tasks", F.coalesce("tasks", "successful"))
        parts = [raw.select(F.lit(b).alias("bucket"), F.inline(b)) for b in ("tasks", "failed_interestingness", "failed_tasks")]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    return _or_empty(spark, schema, read)


def _flat(struct: str) -> str:
    """Column list of a struct type text."""
    from pyspark.sql.types import _parse_datatype_string

    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in _parse_datatype_string(struct).fields)


def read_episodes(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A4: one JSON file for each record (or one record on each line); error rows are skipped."""
    return _or_empty(spark, EPISODE_SCHEMA, lambda: spark.read.schema(EPISODE_SCHEMA).option("multiLine", multi_line).json(path)).where(
        F.col("error").isNull())


def read_bank(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """A5: (completed records, quarantine). In-progress records are left out, unparsable files are kept aside.

    Of records with one id that the record sink wrote at different times the last one counts.
    """
    schema = BANK_SCHEMA + ", written_at double, _corrupt_record string"
    text = _or_empty(spark, "value string, file string", lambda: spark.read.option("wholetext", multi_line).text(path).select(
        "*", F.col("_metadata.file_path").alias("file"))).where(F.trim("value") != "")
    raw = text.withColumn("r", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    # Folders written one for each status carry it in their name.
    status = F.coalesce("r.status", "status") if "status" in text.columns else F.col("r.status")
    bad = raw.where(F.col("r._corrupt_record").isNotNull()).select("file", F.col("r._corrupt_record").alias("_corrupt_record"))
    good = raw.where(F.col("r._corrupt_record").isNull()).select("r.*", status.alias("__status")).drop("_corrupt_record")
    newest = good.where("written_at is not null").groupBy("id").agg(F.max("written_at").alias("__last"))
    good = good.join(newest, "id", "left").where(F.col("written_at").isNull() | (F.col("written_at") == F.col("__last")))
    return good.where(~F.col("__status").eqNullSafe("in_progress")).drop("__status", "__last", "written_at"), bad


CATEGORY_ORDER = ["too_easy", "frontier_solved", "frontier_unsolved", "beyond_frontier"]


def reader_mart(bank: DataFrame) -> DataFrame:
    """Flat scenario rows with goal trajectory and category, in reading order; rows without attempts are skipped."""
    solved = F.exists("attempts", lambda a: F.coalesce(a["solved"], F.lit(False)))
    rows = bank.where(F.col("attempts").isNotNull() & (F.size("attempts") > 0))
    flat = rows.select(
        "id", F.coalesce(F.nullif("scenario_title", F.lit("")), F.left("scenario", F.lit(60))).alias("title"), "classification",
        solved.alias("__s"), F.size("attempts").alias("n_attempts"),
        F.transform(F.array_sort(F.transform("attempts", lambda a: F.struct(a["attempt"].alias("n"), F.coalesce(
            a["scores"]["goal"], F.lit(0.0)).alias("g")))), lambda x: x["g"]).alias("goal_trajectory"))
    flat = flat.withColumn("category", reader_category(solved="__s")).drop("__s")
    return flat.orderBy(custom_order(F.col("category"), CATEGORY_ORDER), "title", "id")


def pool_to_rows(pool: DataFrame, column: str) -> DataFrame:
    """A map task -> trajectories as one row for each trajectory."""
    return pool.select(F.explode(column).alias("task", "list")).select(F.col("task").cast("bigint").alias("task_idx"), F.inline("list"))


def rows_to_pool(rows: DataFrame, key: str = "task_idx") -> DataFrame:
    """Trajectories of each task (K at most) as one list a task."""
    cols = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("trial", *[c for c in cols if c != "trial"]))).alias("trajectories"))
