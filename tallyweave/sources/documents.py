"""Files: which are taken, how each is routed, and records written by hand as JSON.

Cells and words come as tables: what takes them out of XLSX and PDF files is outside this engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyweave.scratch import numbered
from tallyweave.schema import CELL, FOLDER_SUFFIXES, IMAGE_SUFFIXES, MONEY_FIELDS, WORD

MANUAL = ("kind", "source", "date", "description", "payee", "category", "reference", "vendor", "confidence", *MONEY_FIELDS)


def suffix(path: Column | str) -> Column:
    p = F.col(path) if isinstance(path, str) else path
    return F.lower(F.regexp_extract(p, r"(\.[^./\\]+)$", 1))


def file_name(path: Column | str) -> Column:
    return F.substring_index(F.col(path) if isinstance(path, str) else path, "/", -1)


def collect(spark: SparkSession, *paths: str) -> tuple[DataFrame, list[str]]:
    """(files, missing): files (path, length, input_ord) and the given paths that don't exist.

    Of a folder, one level deep, those with known suffixes by name; a file that is
    named itself whatever its suffix. In the order of the paths.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found, missing = [], []
    for i, given in enumerate(paths):
        p = jvm.org.apache.hadoop.fs.Path(given)
        fs = p.getFileSystem(conf)
        if not fs.exists(p):
            missing.append(given)
            continue
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(given).select("path", "length")
        found.append((files.where(suffix("path").isin(*FOLDER_SUFFIXES)) if fs.getFileStatus(p).isDirectory() else files).withColumn("_i", F.lit(i)))
    if not found:
        return spark.createDataFrame([], "path string, length long, input_ord long"), missing
    files = found[0]
    for more in found[1:]:
        files = files.unionByName(more)
    return numbered(files, [F.col("_i"), F.col("path")], "input_ord").withColumn("input_ord", F.col("input_ord") + 1).drop("_i"), missing


def distinct_names(files: DataFrame) -> DataFrame:
    """One file for each file name: the first in input order."""
    named = files.withColumn("name", file_name("path"))
    return named.groupBy("name").agg(F.min_by(F.struct(*files.columns), "input_ord").alias("f")).select("f.*")


def route(files: DataFrame, path: str = "path") -> DataFrame:
    """``files`` with ``route``: image, manual, pdf or unsupported."""
    s = suffix(path)
    return files.withColumn("route", F.when(s.isin(*IMAGE_SUFFIXES), "image").when(s == ".json", "manual").when(s == ".pdf", "pdf").otherwise("unsupported"))


def route_flags(files: DataFrame, path: str = "path") -> DataFrame:
    """One flag for each image and each unsupported file."""
    reason = F.when(F.col("route") == "image", "An image has no text to read; it has to be entered by hand.").otherwise("This type of file is not supported.")
    return files.where("route in ('image', 'unsupported')").select(
        file_name(path).alias("source"), F.lit("file").alias("location"), F.lit("document").alias("field"), suffix(path).alias("raw"), reason.alias("reason"), F.lit("").alias("row_key"))


def scan_flags(files: DataFrame, words: DataFrame, source: str = "source") -> DataFrame:
    """One flag for each document without a text layer."""
    return files.select(source).distinct().join(words.select(F.col("source").alias(source)).distinct(), source, "left_anti").select(
        F.col(source).alias("source"), F.lit("document").alias("location"), F.lit("document").alias("field"), F.lit("").alias("raw"), F.lit("No text layer: a scan.").alias("reason"), F.lit("").alias("row_key"))


def manual_entries(files: DataFrame, content: str = "value", name: str = "name") -> tuple[DataFrame, DataFrame]:
    """(records, flags) from JSON texts: a list of entries, or {"records": [...]}.

    Unknown keys are dropped; money is read from its text and kept to 6 decimals
    (more of them can't be read); dates are ISO only. An entry with money or a
    date that cannot be read becomes a flag, the rest go on; so does a file that
    is no JSON list. Null texts have no entries.
    """
    body = F.trim(F.col(content))
    listed = F.when(body.startswith("{"), F.get_json_object(content, "$.records")).otherwise(body)
    entries = F.from_json(listed, "array<map<string,string>>")
    whole = F.when(body.startswith("{"), F.from_json(body, "map<string,string>").isNotNull() & (listed.isNull() | entries.isNotNull())).otherwise(entries.isNotNull())
    read = files.select(F.col(name).alias("_name"), F.col(content).alias("_content"), entries.alias("entries"), (whole | F.col(content).isNull()).alias("whole"))
    e = read.where("whole").select("_name", F.posexplode(F.coalesce("entries", F.array().cast("array<map<string,string>>"))).alias("i", "m"))

    def given(k: str) -> Column:
        return F.element_at(F.col("m"), F.lit(k))

    def number(k: str) -> Column:
        return F.when(~given(k).rlike(r"\.[0-9]{6,}[1-9]"), given(k).try_cast("decimal(38,6)"))

    fields = {k: (number(k) if k in MONEY_FIELDS else F.try_to_timestamp(given(k), F.lit("yyyy-MM-dd")).cast("date") if k == "date" else given(k)) for k in MANUAL}
    bad = F.col("m").isNull()
    for k in (*MONEY_FIELDS, "date"):
        bad = bad | (given(k).isNotNull() & (given(k) != ("" if k == "date" else "\0")) & fields[k].isNull())
    e = e.withColumn("_bad", F.coalesce(bad, F.lit(True)))
    defaults = {"kind": F.lit("transaction"), "source": F.col("_name"), "confidence": F.lit("clear")}
    columns = [F.coalesce(v, defaults.get(k, F.lit(None if k in MONEY_FIELDS or k == "date" else ""))).alias(k) for k, v in fields.items()]
    good = e.where("not _bad").select(F.xxhash64("_name", "i").alias("record_id"), (F.col("i") + 1).cast("long").alias("input_ord"), *columns)

    def flag(rows: DataFrame, location: Column, raw: Column, reason: str) -> DataFrame:
        return rows.select(F.col("_name").alias("source"), location.alias("location"), F.lit("record").alias("field"), F.coalesce(F.substring(raw, 1, 120), F.lit("")).alias("raw"), F.lit(reason).alias("reason"), F.lit("").alias("row_key"))

    flags = flag(e.where("_bad"), F.concat(F.lit("entry "), F.col("i") + 1), F.to_json("m"), "A value could not be read.")
    return good, flags.unionByName(flag(read.where("not whole"), F.lit("document"), F.col("_content"), "This is no list of entries in JSON."))


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells of workbooks, as parquet in the long form."""
    return spark.read.schema(CELL).parquet(path)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """Positioned words of documents, as parquet."""
    return spark.read.schema(WORD).parquet(path)
