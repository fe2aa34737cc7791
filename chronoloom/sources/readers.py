"""Readers: explicit schemas, bad records set aside, names and positions of files kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators.markup import whole_element

#: Schemas of the file kinds.
TIMELINES = "uid string, person_id string, text string"
WINDOWED = "uid string, person_id string, window_index int, text string"
PAIRS = "array<struct<instruction: string, response: string, evidence: string, error: string>>"
RESPONSES = "person_id string, window_index int, window_token_count int, window_percent_full double, start_date string, end_date string, response_data string"
INSTRUCTIONS = "instruction_id long, question string, person_id long, is_selected_ehr string"
TRAINING = "instruction string, input string, output string, patient_id string"
#: Fixed value: what ends a document among others in a file; no XML may hold it.
XML_END = "\x1e"


def file_name() -> Column:
    return F.col("_metadata.file_name")


def read_jsonl(spark: SparkSession, path: str, schema: str = TIMELINES, limit: int | None = None, key: str = "person_id") -> DataFrame:
    """One JSON object per line, with ``file`` and ``position``; lines that are no JSON go. A limit takes the least keys."""
    # Splits of a file may be dealt to tasks in any order: a line's place is its split's start, then its number there.
    place = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    raw = spark.read.text(path).select(F.col("value"), file_name().alias("file"), place.alias("position"))
    parsed = raw.withColumn("r", F.from_json("value", schema)).where("r IS NOT NULL AND try_parse_json(value) IS NOT NULL")
    rows = parsed.select("r.*", "file", "position")
    return rows if limit is None else rows.orderBy(key, "file", "position").limit(limit)


def read_json_files(spark: SparkSession, path: str, schema: str = RESPONSES) -> tuple[DataFrame, DataFrame]:
    """One JSON record per file: (rows with ``file``, rejects as file and content).

    response_data may be a list or a single object; it is read as a list of pairs either way.
    """
    raw = spark.read.text(path, wholetext=True).select(F.col("value"), file_name().alias("file"))
    good = F.expr("try_parse_json(value)").isNotNull()
    parsed = raw.where(good).select(F.from_json("value", schema).alias("r"), "file").select("r.*", "file")
    if "response_data" in parsed.columns:
        data = F.col("response_data")
        listed = F.when(F.trim(data).startswith("["), data).otherwise(F.concat(F.lit("["), data, F.lit("]")))
        parsed = parsed.withColumn("response_data", F.from_json(listed, PAIRS))
    return parsed, raw.where(~good).select("file", F.col("value").alias("content"))


def read_json_array(spark: SparkSession, path: str, schema: str = TRAINING) -> DataFrame:
    """Files that each hold one JSON array of records."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """(person_id, text) of the documents that ``writers.write_xml`` wrote."""
    raw = spark.read.option("lineSep", XML_END).text(path)
    cut = F.instr("value", "\n")
    head = F.from_json(F.substring("value", F.lit(1), cut - 1), "person_id string")
    return raw.select(head["person_id"].alias("person_id"), F.substring("value", cut + 1, F.length("value")).alias("text"))


def read_numbered_xml(spark: SparkSession, path: str, pattern: str = r"EHR_(\d+)\.xml") -> DataFrame:
    """(patient_id, text) of XML files whose name matches; others are passed over."""
    raw = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), file_name().alias("file"))
    number = F.regexp_extract("file", f"^{pattern}$", 1)
    return raw.where(number != "").select(number.cast("long").alias("patient_id"), F.coalesce("text", F.lit("")).alias("text"))


def read_xml_or_empty(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of XML files, the root element without a declaration; malformed ones have ''. Spark passes over files of no bytes."""
    raw = spark.read.text(path, wholetext=True).select(file_name().alias("file"), F.col("value"))
    return raw.select("file", F.coalesce(whole_element(F.col("value")), F.lit("")).alias("text"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of whole text files."""
    return spark.read.text(path, wholetext=True).select(file_name().alias("file"), F.coalesce("value", F.lit("")).alias("content"))


def read_csv(spark: SparkSession, path: str, required: list[str] | None = None, schema: str | None = None) -> DataFrame:
    """CSV with a header and quoted newlines, plus ``file``; missing required columns are an error."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    rows = (reader.schema(schema) if schema else reader).csv(path)
    missing = sorted(set(required or []) - set(rows.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return rows.withColumn("file", file_name())


def read_template(path: str) -> str:
    """A small text file on the driver; '' if it can't be read."""
    try:
        with open(path, encoding="utf-8") as f:
            return f.read()
    except OSError:
        return ""


def person_of(file: Column) -> Column:
    """The person in a file name <person>_..._<window>.json."""
    return F.split_part(file, F.lit("_"), F.lit(1))


def window_of(file: Column) -> Column:
    return F.regexp_extract(file, r"_(\d+)\.[^.]*$", 1).try_cast("int")
