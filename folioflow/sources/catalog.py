"""The script catalog, the files of scripts and the stored records, from folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ENTRY = "struct<id:string,version:bigint,checksum:string,path:string,name:string,description:string>"
_INDEX = f"schemaVersion long, ref string, scripts map<string,{_ENTRY}>"
_RECORD = "struct<provenance:string,enabled:boolean,okayed:struct<version:bigint,checksum:string>,source:string,command:boolean,description:string,commandName:string>"


def index(spark: SparkSession, folder: str, ref: str = "") -> DataFrame:
    """The entries of ``index.json`` in ``folder``: id, version, checksum, path, name, description and ref, which is the caller's and never the file's."""
    entries = spark.read.schema(_INDEX).json(f"{folder}/index.json", multiLine=True).select(F.explode("scripts").alias("id", "e"))
    return entries.select("id", *[f"e.{c}" for c in ("version", "checksum", "path", "name", "description")], F.lit(ref).alias("ref"))


def files(spark: SparkSession, folder: str, pattern: str = "*.cjs") -> DataFrame:
    """id (the name of the file without its ending), path and content of the scripts below ``folder``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return found.select(F.regexp_replace(F.regexp_extract("path", r"([^/]*)\z", 1), r"(?i)\.cjs\z", "").alias("id"), "path", "content")


def records(spark: SparkSession, path: str) -> DataFrame:
    """Stored script records, one JSON object of records by id in the field ``scripts``: a row each, what is missing or of another type as null."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"scripts map<string,{_RECORD}>").alias("v")).select(F.explode("v.scripts").alias("id", "r"))
    return raw.select("id", "r.provenance", "r.enabled", F.col("r.okayed.version").alias("okayed_version"), F.col("r.okayed.checksum").alias("okayed_checksum"), "r.source", "r.command", "r.description", F.col("r.commandName").alias("command_name"))


def versions(spark: SparkSession, path: str) -> DataFrame:
    """id, version of the scripts that this device has written, from a JSON object of numbers by id; a malformed file has none."""
    numbers = F.from_json("value", T.MapType(T.StringType(), T.LongType()))
    return spark.read.text(path, wholetext=True).select(F.explode(numbers).alias("id", "version")).where("version is not null")
