"""JSON Lines, source trees and reports in, task records out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codegrain.operators.paths import EXTENSIONS, is_source
from codegrain.operators.quality import good_code

#: One task record. context_code is an array of [path, code] pairs on disk.
RECORD = """repo_name string, file_name string,
inference_info struct<prefix_code:string,suffix_code:string,middle_code:string,code_description:string,fill_type:string,language_type:string,sub_task_type:string>,
context_code array<array<string>>,
task_instance_info struct<created_time:string,created_task_model:string,class_skeleton:string,function_skeleton:string,code_description:string>,
inference_content struct<inference_model:string,inference_result:string,inference_time:string>,
editdistance_info struct<edit_distance:double,calculate_time:string,true_code_clean:string,predict_code_clean:string>,
generated_code string, error string"""


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str = RECORD, strict: bool = False, most: int | None = None) -> DataFrame:
    """Lines that are JSON objects; blank lines don't count, malformed ones are dropped or, if strict, fail the read.

    A directory is read flat, its *.jsonl only. most limits the rows.
    """
    reader = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    paths = [path] if isinstance(path, str) else path
    if not all(p.endswith((".jsonl", ".json")) for p in paths):
        reader = reader.option("pathGlobFilter", "*.jsonl")
    out = reader.json(paths)
    return out if most is None else out.limit(most)


def malformed(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """The lines that read_jsonl() drops."""
    lines = spark.read.text(path, pathGlobFilter="*.jsonl" if not path.endswith((".jsonl", ".json")) else "*").where(F.trim("value") != "")
    told = lines.select("value", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return told.where("r._bad is not null").select(F.col("value").alias("_bad"))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one JSON value."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_jsonl(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), one_file: bool = False) -> None:
    """UTF-8, an object a line, null fields left out; replaces what was there."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").partitionBy(*partition_by).json(path)


def write_pretty(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).write.mode("overwrite").text(path)


def context_pairs(pairs: Column) -> Column:
    """array<struct<path, code>> of the pairs on disk."""
    return F.transform(pairs, lambda p: F.struct(p[0].alias("path"), p[1].alias("code")))


def is_repo(name: Column) -> Column:
    """Folders named build or beginning with a dot are no repositories."""
    return ~F.startswith(name, F.lit(".")) & (name != "build")


def read_sources(spark: SparkSession, root: str, language: str) -> DataFrame:
    """(repo_name, path, language, code) of the files below root/REPO/ that are sources of the language.

    Names are filtered before a file is opened. Repositories named build or beginning with a dot are skipped, and so
    are files that are not UTF-8.
    """
    glob = "*{" + ",".join(EXTENSIONS[language]) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    inside = F.regexp_extract("path", r"\Q" + root.rstrip("/").split(":")[-1] + r"\E/(.*)$", 1)
    named = files.select(F.substring_index(inside, "/", 1).alias("repo_name"), F.regexp_extract(inside, r"^[^/]+/(.*)$", 1).alias("path"), F.lit(language).alias("language"), F.try_validate_utf8(F.col("content").cast("string")).alias("code"))
    return named.where(is_repo(F.col("repo_name")) & is_source(F.col("path"), language) & F.col("code").isNotNull())


def read_good(spark: SparkSession, path: str | list[str], schema: str, column: str = "text", **options) -> DataFrame:
    """What read_jsonl() reads, without the rows whose code is not plausible."""
    return read_jsonl(spark, path, schema, **options).where(good_code(F.col(column)))


def write_scored(df: DataFrame, path: str) -> None:
    """Scored records, a folder for each language and model; both stay in the records, too."""
    df.withColumns({"language": F.col("inference_info.language_type"), "model": F.col("inference_content.inference_model")}).write.mode("overwrite").partitionBy("language", "model").json(path)


def read_scored(spark: SparkSession, scored: str, baseline: str) -> DataFrame:
    """Scored records of evaluated models and of the model that made the tasks, whose records are the benchmark itself."""
    return read_jsonl(spark, scored).unionByName(read_jsonl(spark, baseline), allowMissingColumns=True)
