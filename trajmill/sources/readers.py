"""Reading rollouts, run documents, dimensions and manifests. Schemas are explicit; order is an explicit column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajmill.sources import documents

TOOL_CALL = "struct<id:string,type:string,name:string,arguments:string,function:struct<name:string,arguments:string>>"
MESSAGE = f"struct<role:string,content:string,tool_calls:array<{TOOL_CALL}>,id:string,tool_call_id:string,name:string,error:boolean,turn_idx:int>"
ROLLOUT = f"task_id string, trial int, reward double, messages array<{MESSAGE}>, gold array<string>"
SIMULATION = (
    "struct<id:string,task_id:string,trial:int,termination_reason:string,reward_info:struct<reward:double,db_check:struct<db_match:boolean,db_reward:double>,reward_breakdown:map<string,double>,"
    f"action_checks:array<struct<action:struct<name:string,arguments:string>,action_match:boolean>>>,messages:array<{MESSAGE}>>"
)
RUN = f"info struct<num_trials:int,environment_info:struct<domain_name:string>,agent_info:struct<implementation:string,llm:string>>, tasks array<struct<id:string>>, simulations array<{SIMULATION}>"
MANIFEST = "timestamp string, task_id string, trial int, seed int, status string, exit_code string, duration_seconds double, save_to string, stdout string, stderr string"


def _kind() -> T.StructType:
    return T.StructType.fromDDL(f"s {SIMULATION}")["s"].dataType


def with_origin(df: DataFrame) -> DataFrame:
    return df.withColumn("file_path", F.col("_metadata.file_path"))


def lenient_jsonl(spark: SparkSession, path: str | list[str], schema: str = ROLLOUT) -> DataFrame:
    """One object a line; blank lines are skipped, a malformed one raises."""
    return with_origin(spark.read.schema(schema).option("mode", "FAILFAST").json(path))


def strict_jsonl(spark: SparkSession, path: str | list[str], schema: str = ROLLOUT) -> DataFrame:
    """As lenient_jsonl, but a malformed line raises with its file and line number.

    The input is read twice: once for a bad line, once for the result. Only a file with a bad line is numbered, in one task that
    streams through it."""
    broken = "__broken"
    kind = T.StructType.fromDDL(schema).add(broken, T.StringType())
    lines = with_origin(spark.read.text(path)).where(F.trim("value") != "")
    parsed = lines.withColumn("r", F.from_json("value", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": broken}))
    if bad := parsed.where(F.col(f"r.{broken}").isNotNull()).select("file_path", "value").first():
        raise ValueError(f"{bad['file_path']}:{_line_number(spark, bad['file_path'], bad['value'])}: not JSON: {bad['value'][:200]}")
    return lenient_jsonl(spark, path, schema)


def _line_number(spark: SparkSession, file: str, line: str) -> int | None:
    def number(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        n = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                if text.strip() == line.strip():
                    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    found = spark.read.text(file).coalesce(1).mapInArrow(number, "n bigint").agg(F.min("n")).first()
    return found[0]


def any_run(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The simulations of files that hold a results object or a bare list of simulations, with file_path and position."""
    found = documents.elements(spark, paths, "simulations", bare=True)
    return found.select("file_path", F.col("ordinal").alias("position"), F.from_json("value", _kind()).alias("s")).select("file_path", "position", "s.*")


def qa_items(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """Questions and answers (ordinal, question, answer) of a JSON lines file or a Parquet table, the first n by order in the file."""
    own = T.StructType.fromDDL("question string, answer string")
    df = spark.read.parquet(path).select("question", "answer") if path.rstrip("/").endswith(".parquet") else spark.read.schema(own).option("mode", "FAILFAST").json(path)
    df = df.withColumn("ordinal", F.monotonically_increasing_id()).select("ordinal", "question", "answer")
    return df.orderBy("ordinal").limit(n) if n else df


def dimension(df: DataFrame, key: str, ordinal: str, columns: list[str] | None = None) -> DataFrame:
    """A keyed table as the join side: keys as text, of equal ones the last, null keys out."""
    df = last_wins(df.where(F.col(key).isNotNull()).withColumn(key, F.col(key).cast("string")), key, ordinal)
    return df.select(key, *(columns or [c for c in df.columns if c not in (key, ordinal)]))


def named_paths(specs: list[str]) -> list[tuple[str, str]]:
    """`name=path` arguments as pairs; a bare path is named by its file without the ending. Repeated names are an error."""
    out = []
    for spec in specs:
        name, eq, path = spec.partition("=")
        if not eq:
            name, path = spec.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0], spec
        if not name or not path or name in dict(out):
            raise ValueError(f"not a new name=path: {spec}")
        out.append((name, path))
    return out


def run_document(spark: SparkSession, path: str, folder: str | None = None, inline_first: bool = False) -> DataFrame:
    """The simulations of a results file, a row each. Files of `folder` replace those in the file, or (inline_first) stand in
    where it holds none; neither is an error."""
    inline = documents.elements(spark, path, "simulations").select(F.col("ordinal").cast("int").alias("ordinal"), F.from_json("value", _kind()).alias("s")).where("s is not null").select("ordinal", "s.*")
    if folder is not None and (not inline_first or inline.isEmpty()):
        kind = _kind()
        files = with_origin(spark.read.schema(kind).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder))
        order = F.row_number().over(Window.orderBy("file_path")) - 1  # as many rows as one run has simulations
        inline = files.withColumn("ordinal", order).select("ordinal", *[f.name for f in kind])
    if inline_first and inline.isEmpty():
        raise ValueError(f"{path}: no simulations")
    return inline


def shard_documents(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """The simulations of every results.json below root whose folder's name starts with prefix, in order of path."""
    df = documents.elements(spark, root, "simulations", recursiveFileLookup="true", pathGlobFilter="results.json")
    shard = F.element_at(F.split("file_path", "/"), -2)
    df = df.withColumn("shard", shard).where(F.startswith(F.col("shard"), F.lit(prefix)))
    return df.select("file_path", "shard", F.col("ordinal").alias("position"), F.from_json("value", _kind()).alias("s")).select("file_path", "shard", "position", "s.*")


def shard_task(shard: Column) -> Column:
    """struct(task_id, trial) read off a shard's name: `trial2_task_7`, else `task_7_trial_2`."""
    first, second = r"(?i)trial[_-]?(\d+)[_-]task[_-]?(\d+)", r"(?i)task[_-]?(\d+)[_-]trial[_-]?(\d+)"
    got = lambda p, g: F.nullif(F.regexp_extract(shard, p, g), F.lit(""))
    return F.struct(F.coalesce(got(first, 2), got(second, 1)).alias("task_id"), F.coalesce(got(first, 1), got(second, 2)).cast("int").alias("trial"))


def last_wins(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """A keyed dimension: of rows with one key the last."""
    w = Window.partitionBy(key).orderBy(F.desc(ordinal))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def ids(spark: SparkSession, text: str) -> DataFrame:
    """Ids given as text, apart by commas or white space: task_id, in order."""
    return spark.createDataFrame([(i, x) for i, x in enumerate(text.replace(",", " ").split())], "ordinal int, task_id string")


def current_time(spark: SparkSession, path: str, default: str = "2024-05-15 15:00:00") -> Column:
    """The time that a policy document names as the current one."""
    found = spark.read.text(path, wholetext=True).select(F.regexp_extract("value", r"(?i)current time is (\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})", 1).alias("t")).first()
    return F.lit((found and found.t) or default).cast("timestamp_ntz")


def corpus_of_questions(df: DataFrame, titles: str, sentences: str, chars: int = 200) -> DataFrame:
    """Passages `title: sentences` of questions' parallel arrays, the first of those that agree in `chars` characters."""
    long = df.select("ordinal", F.posexplode(F.arrays_zip(F.col(titles).alias("t"), F.col(sentences).alias("s"))).alias("pos", "p"))
    text = F.concat(F.col("p.t"), F.lit(": "), F.array_join("p.s", " "))
    w = Window.partitionBy(F.substring("passage", 1, chars)).orderBy("ordinal", "pos")
    return long.select("ordinal", "pos", text.alias("passage")).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def finished_shards(spark: SparkSession, root: str) -> DataFrame:
    """The shards that hold simulations."""
    return shard_documents(spark, root).select("shard").distinct()
