"""JSON Lines, JSON, Parquet and log sources, and sinks.  Paths may be in any store that Spark reads."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_BAD = "_corrupt"


def _schema(schema: str | StructType) -> StructType:
    return schema if isinstance(schema, StructType) else StructType.fromDDL(schema)


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str | StructType, policy: str = "skip", missing_ok: bool = False) -> DataFrame:
    """Rows of JSON Lines with ``_file`` and ``_ord`` (the line's place in its file).

    policy ``skip``: bad lines and empty objects go; ``keep_empty``: bad lines go; ``truncate``: a file ends before its
    first bad line; ``failfast``: a bad line is an error.  Blank lines are never rows.  A path that isn't there is an
    error, or no rows if ``missing_ok``.
    """
    s = _schema(schema)
    try:
        raw = spark.read.option("lineSep", "\n").text(path).select(F.regexp_replace("value", r"\r$", "").alias("value"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    except AnalysisException:
        if not missing_ok:
            raise
        return spark.createDataFrame([], StructType([*s.fields]).add("_file", "string").add("_ord", "long"))
    raw = raw.where("trim(value) != ''")
    mode = "FAILFAST" if policy == "failfast" else "PERMISSIVE"
    parsed = raw.select("_file", "_block", "_at", F.trim("value").alias("_line"), F.from_json("value", StructType([*s.fields]).add(_BAD, "string"), {"mode": mode, "columnNameOfCorruptRecord": _BAD}).alias("_x"))
    bad = F.col(f"_x.{_BAD}").isNotNull()
    # Blocks of a file are in order of their start, and lines of a block in order of their running number.
    place = F.struct("_block", "_at")
    if policy == "truncate":
        first = parsed.where(bad).groupBy("_file").agg(F.min(place).alias("_first"))
        parsed = parsed.join(first, "_file", "left").where(F.col("_first").isNull() | (place < F.col("_first")))
    else:
        parsed = parsed.where(~bad)
    if policy == "skip":
        parsed = parsed.where(~F.col("_line").rlike(r"^\{\s*\}$"))
    return parsed.select(*(F.col(f"_x.`{f.name}`") for f in s.fields), "_file", "_block", "_at").transform(_numbered)


def _numbered(rows: DataFrame) -> DataFrame:
    """``_ord``: the place in the file, from the rows of a file's earlier blocks and the place in the block, so that no task sorts more than a block."""
    blocks = rows.groupBy("_file", "_block").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_file", "_block", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_file", "_block").orderBy("_at")) - 1
    placed = rows.withColumn("_within", within).join(blocks, ["_file", "_block"])
    return placed.withColumn("_ord", (F.col("_before") + F.col("_within")).cast("long")).drop("_block", "_at", "_before", "_within")


def read_json_array(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    return spark.read.schema(_schema(schema)).option("multiLine", True).json(path)


def read_any(spark: SparkSession, paths: list[str], schema: str | StructType) -> DataFrame:
    """The union of .jsonl and .json files."""
    frames = [read_jsonl(spark, p, schema, "keep_empty").drop("_file", "_ord") if p.endswith(".jsonl") else read_json_array(spark, p, schema) for p in paths]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def read_parquet(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Rows of a Parquet table; none, of the schema stated, where there is no table."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], _schema(schema))


def read_trainer_states(spark: SparkSession, path: str) -> DataFrame:
    """run (the folder), log_history, of trainer_state.json files."""
    schema = "log_history array<struct<step: bigint, loss: double, eval_loss: double>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("run"), F.coalesce("log_history", F.expr("cast(array() as array<struct<step: bigint, loss: double, eval_loss: double>>)")).alias("log_history"))


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path and size of the files below a folder, without their contents."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder).select("path", F.col("length").alias("size"))


def write_jsonl(df: DataFrame, path: str, files: int | None = None, if_exists: str = "overwrite") -> None:
    """JSON Lines, nulls left out.  ``files``: as many files at most, for small results.  if_exists ``ignore`` leaves what is there."""
    (df.coalesce(files) if files else df).write.mode(if_exists).option("ignoreNullFields", True).json(path)


def write_by(df: DataFrame, path: str, column: str) -> None:
    """A folder for each value of a column."""
    df.write.mode("overwrite").partitionBy(column).json(path)


def json_array(df: DataFrame, order: str) -> DataFrame:
    """One row with all rows as a JSON array, for small results."""
    return df.agg(F.array_sort(F.collect_list(F.struct(order, F.struct(*df.columns).alias("row")))).alias("l")).select(F.to_json(F.transform("l", lambda x: x["row"])).alias("json"))


def write_hub_layout(samples: DataFrame, path: str) -> None:
    """train.jsonl (a folder of parts) and dataset_info.json with counts, below a path."""
    write_jsonl(samples, f"{path}/train.jsonl")
    info = dataset_info(samples).select(F.col("total").alias("total_samples"), F.col("qa").alias("qa_samples"), F.col("design").alias("design_samples"), F.lit("jsonl").alias("format"))
    write_jsonl(info, f"{path}/dataset_info.json", 1)


def write_results(results: DataFrame, path: str, at: str) -> str:
    """The rows of an evaluation as JSON in a folder named by a time; its path."""
    folder = f"{path}/evaluation_{at}/evaluation_results.json"
    write_jsonl(results, folder, 1, "errorifexists")
    return folder


def dataset_info(samples: DataFrame) -> DataFrame:
    return samples.agg(F.count("*").alias("total"), F.count_if(F.col("type") == "qa").alias("qa"), F.count_if(F.col("type") == "design").alias("design"))
