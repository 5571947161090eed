"""Files: uploads, annotations, texts beside records, and the folder that all executors share."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

MAX_UPLOAD = 10 * 1024 * 1024
LEAST_TEXT = 50
KINDS = {"string": StringType(), "number": DoubleType(), "integer": LongType(), "boolean": BooleanType()}


def result_path(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir; below a temporary one only in local mode without that setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="clausewright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/clausewright-{uuid.uuid4().hex}/{label}"


def uploads(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """path, length, content, error_code of the files in a folder.

    FILE_TOO_LARGE is told from the length alone; contents over the limit are not returned. Empty files give no row:
    Spark's reader passes them over."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    error = F.when(F.col("length") > MAX_UPLOAD, "FILE_TOO_LARGE")
    return f.select("path", "length", F.when(F.col("length") <= MAX_UPLOAD, F.col("content")).alias("content"), error.alias("error_code"))


def annotations(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The records of a folder's JSON files, one a file, with name; files whose name starts with _ or that don't parse are left out."""
    bad = "_corrupt_record"
    full = StructType([*schema.fields, StructField(bad, StringType())])
    r = spark.read.schema(full).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).option("pathGlobFilter", "[!_]*.json").json(path)
    return r.withColumn("name", F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")).where(F.col(bad).isNull()).drop(bad)


def with_texts(records: DataFrame, given: DataFrame, spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    """records and their text: given (key, text), else their own text, else their 原文 column, else {key}.txt; shorter than 50 go."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.txt").text(path)
    files = files.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "").alias(key), F.col("value").alias("_file"))
    joined = records.join(given.select(key, F.col("text").alias("_given")), key, "left").join(files, key, "left")
    own = [F.nullif(F.col(c), F.lit("")) for c in ("text", "_合同原文") if c in records.columns]
    text = F.coalesce(F.nullif("_given", F.lit("")), *own, F.col("_file"))
    return joined.withColumn("text", text).where(F.length(F.trim("text")) >= LEAST_TEXT).drop("_given", "_file")


def looked_up(dictionary: dict, dotted: str):
    """The value at a dotted path of a dictionary; None where there is none."""
    for part in dotted.split("."):
        if not isinstance(dictionary, dict) or part not in dictionary:
            return None
        dictionary = dictionary[part]
    return dictionary


def field_schema(dictionary: dict, fields: str = "fields") -> tuple[StructType, dict[str, list[str]], list[str]]:
    """The type of a record, its enumerations and its required fields, of a dictionary that describes them.

    A field is {type, required, values}; type may add |null; values may be a dotted path. Unknown types are strings."""
    kinds, values, required = [], {}, []
    for name, spec in dictionary[fields].items():
        kind, *null = spec.get("type", "string").split("|")
        kinds.append(StructField(name, KINDS.get(kind, StringType()), True))
        listed = spec.get("values")
        if isinstance(listed, str):
            listed = looked_up(dictionary, listed)
        if listed:
            values[name] = list(listed)
        if spec.get("required"):
            required.append(name)
    return StructType(kinds), values, required


def parsed(raw: Column, schema: StructType, values: dict[str, list[str]], required: list[str]) -> Column:
    """(record, errors) of a JSON object: keys that are missing, values beyond an enumeration, values of another type."""
    record = F.from_json(raw, schema)
    # a key counts as there where its value is null
    keys = F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))
    given = lambda n: F.get_json_object(raw, f"$.{n}")
    wrong = [F.when(~F.array_contains(keys, n), f"missing:{n}") for n in required]
    wrong += [F.when(record[n].isNotNull() & ~record[n].isin(v), f"enum:{n}") for n, v in values.items()]
    wrong += [F.when(given(f.name).isNotNull() & given(f.name).try_cast(f.dataType).isNull(), f"type:{f.name}") for f in schema.fields if not isinstance(f.dataType, StringType)]
    return F.struct(record.alias("record"), F.array_compact(F.array(*wrong)).alias("errors"))


def rendered(template: str, **columns: Column) -> Column:
    """A template with {name} replaced by columns; unknown names stay, null becomes empty."""
    out = F.lit(template)
    for name, c in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c.cast("string"), F.lit("")))
    return out


def schema_text(schema: StructType, required: list[str]) -> str:
    return json.dumps({f.name: f.dataType.simpleString() + ("" if f.name in required else "|null") for f in schema.fields}, ensure_ascii=False, indent=2)
