"""Reading and writing transcripts, chunks and data sets as files and tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnmill.functions.text import file_name, title_of_file

SEGMENT = T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), T.StructField("cue_start", T.DoubleType()), T.StructField("cue_end", T.DoubleType()), T.StructField("vimeo_generated_speaker", T.StringType())])
CHUNK = T.StructType([T.StructField("chunk_id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("title", T.StringType()), T.StructField("cue_start", T.DoubleType()), T.StructField("cue_end", T.DoubleType()), T.StructField("chunk_index", T.IntegerType()), T.StructField("total_chunks", T.IntegerType())])
REQUIRED = ("title", "text", "cue_start", "cue_end")


class Invalid(ValueError):
    """A source that cannot be used."""


def read_segments(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Cues from CSV files with a header, and ``(file, problem)`` of the files left out.

    A file is left out whole if it lacks a required column, has no rows or a time that is no
    number; the others go on. Columns are matched by the header, whatever their order; the
    speaker column may be missing.
    """
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("at"), "value")
    raw = lines.groupBy("file").agg(F.trim(F.regexp_replace(F.min_by("value", "at"), r"^\x{FEFF}", "")).alias("header"))
    names = F.transform(F.split(F.col("header"), ","), lambda c: F.trim(F.regexp_replace(c, '"', "")))
    missing = F.array_except(F.array(*map(F.lit, REQUIRED)), names)
    heads = raw.withColumn("names", names).withColumn("missing", missing)
    layouts = [r["names"] for r in heads.where(F.size("missing") == 0).select("names").distinct().collect()]
    parts = []
    for layout in layouts:
        files = [r["file"] for r in heads.where((F.size("missing") == 0) & (F.array_join("names", ",") == ",".join(layout))).select("file").collect()]
        schema = T.StructType([T.StructField(c, T.StringType()) for c in layout])
        rows = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(files)
        speaker = F.col("vimeo_generated_speaker") if "vimeo_generated_speaker" in layout else F.lit(None).cast("string")
        parts.append(rows.select(F.col("_metadata.file_path").alias("file"), "title", "text", "cue_start", "cue_end", speaker.alias("vimeo_generated_speaker")))
    cues = spark.createDataFrame([], T.StructType([T.StructField("file", T.StringType()), *[T.StructField(f.name, T.StringType()) for f in SEGMENT]]))
    for part in parts:
        cues = cues.unionByName(part)
    number = lambda c: F.col(c).try_cast("double")
    per_file = cues.groupBy("file").agg(F.count("*").alias("rows"), F.count_if(number("cue_start").isNull() & F.col("cue_start").isNotNull() | number("cue_end").isNull() & F.col("cue_end").isNotNull()).alias("bad"))
    told = heads.select("file", "missing").join(per_file, "file", "left")
    problem = (
        F.when(F.size("missing") > 0, F.concat(F.lit("missing columns: "), F.array_join("missing", ", ")))
        .when(F.coalesce("rows", F.lit(0)) == 0, "no rows")
        .when(F.col("bad") > 0, F.concat(F.lit("times that are no numbers: "), F.col("bad")))
    )
    problems = told.select("file", problem.alias("problem")).where("problem is not null")
    good = cues.join(problems.select("file"), "file", "left_anti")
    return good.select("title", "text", number("cue_start").alias("cue_start"), number("cue_end").alias("cue_end"), "vimeo_generated_speaker"), problems


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``(title, body)`` of whole text files, the title from the file's stem."""
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    return spark.read.text(path, wholetext=True).select(title_of_file(stem).alias("title"), F.col("value").alias("body"))


def payload(body: Column) -> Column:
    """What follows ``": "`` on the first line that has it, without one closing quote, else all."""
    found = F.regexp_extract(body, r'(?m)": "(.*?)"?$', 1)
    return F.when(found == "", body).otherwise(found)


def write_texts(df: DataFrame, title: str, body: str, path: str) -> None:
    """One folder of text a title, named after it."""
    out = df.select(F.col(body).alias("value"), F.concat(file_name(F.col(title)), F.lit(".md")).alias("file"))
    out.repartition("file").write.mode("overwrite").partitionBy("file").text(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from files that hold one JSON array each, without their ids; checked by
    :func:`checked_chunks`."""
    df = spark.read.schema(CHUNK).option("multiLine", True).json(path)
    return checked_chunks(df).drop("chunk_id")


def checked_chunks(df: DataFrame) -> DataFrame:
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise Invalid(f"missing columns: {', '.join(missing)}")
    if df.isEmpty():
        raise Invalid("no rows")
    return df


def write_chunks(df: DataFrame, path: str) -> None:
    """JSON lines, one folder a title."""
    df.withColumn("file", file_name(F.col("title"))).repartition("file").write.mode("overwrite").partitionBy("file").json(path)


def read_entries(spark: SparkSession, path: str, entries: str, schema: str) -> DataFrame:
    """The rows of an envelope ``{"metadata": …, entries: [...]}``."""
    df = spark.read.schema(f"`{entries}` array<{schema}>").option("multiLine", True).json(path)
    return df.select(F.inline(entries))


def read_transcript_map(spark: SparkSession, path: str) -> DataFrame:
    """``(title, text)`` of an envelope ``{"transcripts": {title: text}}``."""
    df = spark.read.schema("transcripts map<string,string>").option("multiLine", True).json(path)
    return df.select(F.explode("transcripts").alias("title", "text"))


class Strategies:
    """Chunking strategies by name, each a table with the vectors and texts to search.

    Names go into table names, so only letters, figures and underscores are taken.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def table(self, name: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9_]+", name):
            raise Invalid(f"not a name for a strategy: {name!r}")
        return f"chunks_{name}"

    def append(self, name: str, chunks: DataFrame, key: str = "chunk_id") -> None:
        """Adds the chunks that are not there yet, so that a second run adds nothing."""
        t = self.table(name)
        if self.spark.catalog.tableExists(t):
            chunks = chunks.join(self.spark.table(t).select(key), key, "left_anti")
            chunks.write.mode("append").saveAsTable(t)
        else:
            checked_chunks(chunks).write.format("parquet").saveAsTable(t)

    def load(self, name: str) -> DataFrame:
        return self.spark.table(self.table(name))

    def truncate(self, name: str) -> None:
        self.spark.sql(f"TRUNCATE TABLE {self.table(name)}")

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table(name)}")

    def checks(self, name: str, width: int | None = None) -> dict[str, bool]:
        """Whether the table, its columns and its content are as a search needs them."""
        t = self.table(name)
        out = {"table": self.spark.catalog.tableExists(t)}
        if out["table"]:
            columns = {c.name for c in self.spark.catalog.listColumns(t)}
            out |= {f"column {c}": c in columns for c in (*REQUIRED, "embedding")}
            if all(out.values()):
                bad = F.col("text").isNull() | F.col("title").isNull() | F.col("embedding").isNull()
                if width is not None:
                    bad = bad | (F.size("embedding") != width)
                row = self.load(name).agg(F.count("*").alias("n"), F.count_if(bad).alias("bad")).first()
                out |= {"rows": row["n"] > 0, "content": row["bad"] == 0}
        return out
