"""Text and table files: readers that settle encodings and headers, writers that replace."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formulake import vocab as V
from formulake.operators.groups import first_rows
from formulake.session import new_path

# The encodings tried, in order, and their Java names.
ENCODINGS = ["UTF-8", "x-windows-949", "ISO-8859-1"]
# Fixed value: one well-formed unit of the Korean Windows code page, as hex digits.
CP949_UNIT = (
    r"\G(?:[0-7][0-9A-F]|(?:8[1-9A-F]|[9A-E][0-9A-F]|F[0-9A-E])"
    r"(?:4[1-9A-F]|5[0-9A]|6[1-9A-F]|7[0-9A]|8[1-9A-F]|[9A-E][0-9A-F]|F[0-9A-E]))"
)


def classify_encodings(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per file with the first encoding all its lines are valid in.

    The text reader keeps raw bytes, so files are checked line by line in parallel and are
    never loaded whole.
    """
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("value")
    )
    rest = F.regexp_replace(F.hex(F.col("value").cast("binary")), CP949_UNIT, "")
    per_file = lines.groupBy("path").agg(
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"),
        F.bool_and(rest == "").alias("cp949"),
    )
    return per_file.select(
        "path",
        F.when(F.col("utf8"), ENCODINGS[0]).when(F.col("cp949"), ENCODINGS[1])
        .otherwise(ENCODINGS[2]).alias("encoding"),
    )


# Quotes are doubled inside quoted fields, which may hold line breaks; records that don't fit are
# kept in a column of their own where the schema has it.
CSV = {"header": "true", "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
BROKEN = "_corrupt_record"


def read_csv_any(
    spark: SparkSession, paths: list[str], schema: T.StructType, keep_broken: bool = False
) -> DataFrame:
    """CSV files of mixed encodings as one table; only file names reach the driver.

    With ``keep_broken`` a column holds the text of each record that the schema doesn't fit.
    """
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    if keep_broken:
        schema = T.StructType([*schema.fields, T.StructField(BROKEN, T.StringType())])
    by_encoding: dict[str, list[str]] = {}
    for row in classify_encodings(spark, paths).collect():
        by_encoding.setdefault(row["encoding"], []).append(row["path"])
    parts = [
        spark.read.schema(schema).options(**CSV, columnNameOfCorruptRecord=BROKEN)
        .option("encoding", encoding).csv(sorted(files))
        for encoding, files in sorted(by_encoding.items())
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def canonical_header(name: str) -> str | None:
    """Canonical column of a loose header, None when unknown."""
    if name in V.FORMULATION_CORE:
        return name
    spelled = name.strip().lower().replace(" ", "_").replace("(%)", "").strip("_")
    return V.HEADER_ALIASES.get(spelled)


def align_columns(df: DataFrame) -> DataFrame:
    """Rename loose headers; two headers for one column are merged left to right."""
    sources: dict[str, list[str]] = {}
    for name in df.columns:
        sources.setdefault(canonical_header(name) or name, []).append(name)

    def quoted(name: str) -> Column:
        return F.col(f"`{name}`")

    return df.select(*[
        (quoted(names[0]) if len(names) == 1 else F.coalesce(*[quoted(n) for n in names]))
        .alias(target)
        for target, names in sources.items()
    ])


def align_report(columns: list[str]) -> list[tuple[str, str]]:
    """(source, target) for every header that is renamed."""
    renamed = [(c, canonical_header(c)) for c in columns]
    return [(c, t) for c, t in renamed if t is not None and t != c]


def merge_files(spark: SparkSession, folders: list[str], keys: list[str], order: str) -> DataFrame:
    """Contributors' CSV folders as one table: headers aligned, source tagged, first row kept.

    Every folder is read in the encodings its files are in; the source is the folder's name.
    """
    merged = None
    for folder in folders:
        header = spark.read.options(**CSV).csv(folder).columns
        schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
        part = align_columns(read_csv_any(spark, [folder], schema))
        part = part.withColumn("source_file", F.lit(folder.rstrip("/").rsplit("/", 1)[-1]))
        merged = part if merged is None else merged.unionByName(part, allowMissingColumns=True)
    present = [k for k in keys if k in merged.columns]
    return first_rows(merged, present, [F.col("source_file"), F.col(order)])


def strict_select(df: DataFrame, expected: list[str]) -> DataFrame:
    """The expected columns in order; fails with the list of missing ones."""
    missing = [c for c in expected if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*expected)


def empty_store(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_lookup_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON objects of name to value, one row per pair."""
    pairs = F.from_json("value", T.MapType(T.StringType(), T.StringType()))
    return spark.read.text(path).select(F.explode(pairs).alias("name", "smiles"))


def expand_payload(df: DataFrame, payload: str, schema: T.StructType) -> DataFrame:
    """Rows stored as JSON documents, expanded to columns."""
    parsed = df.withColumn("_p", F.from_json(payload, schema))
    return parsed.select(*[c for c in df.columns if c != payload], "_p.*")


def infer_payload_schema(df: DataFrame, payload: str) -> T.StructType:
    """Schema of JSON documents, merged over all rows without leaving the JVM.

    Documents are written a line each; line breaks between their parts become blanks, and none can stand
    inside their strings.
    """
    path = new_path(df.sparkSession, "payload")
    df.select(F.translate(payload, "\r\n", "  ").alias("value")).write.text(path)
    return df.sparkSession.read.json(path).schema


def to_payload(df: DataFrame, key: str) -> DataFrame:
    """One JSON document per row."""
    return df.select(key, F.to_json(F.struct(*[c for c in df.columns])).alias("payload"))


def write_payload_jdbc(df: DataFrame, key: str, url: str, table: str, **options: str) -> None:
    """Replace a database table by JSON rows, 500 per batch."""
    to_payload(df, key).write.format("jdbc").options(
        url=url, dbtable=table, batchsize="500", **options
    ).mode("overwrite").save()


def replace_table(df: DataFrame, root: str) -> str:
    """Write a new version and point to it; a version that is being read is never touched."""
    spark = df.sparkSession
    seen = list_versions(spark, root)
    version = (seen[-1] + 1) if seen else 1
    df.write.parquet(f"{root}/version={version}")
    return f"{root}/version={version}"


def list_versions(spark: SparkSession, root: str) -> list[int]:
    """Complete versions, oldest first."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = []
    for status in fs.listStatus(path):
        match = re.fullmatch(r"version=(\d+)", status.getPath().getName())
        done = jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if match and fs.exists(done):
            found.append(int(match.group(1)))
    return sorted(found)


def read_table(spark: SparkSession, root: str) -> DataFrame:
    """The newest complete version."""
    return spark.read.parquet(f"{root}/version={list_versions(spark, root)[-1]}")


def append_table(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """Quoted fields, quotes inside them doubled, line breaks kept."""
    df.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
