"""Files as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parallax.functions import text
from parallax.operators.codefront import EXTENSIONS, language


def scan(spark: SparkSession, root: str, *, recursive: bool = True, max_depth: int | None = None, hidden: bool = False, extensions: tuple[str, ...] | None = None, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), max_bytes: int | None = None) -> DataFrame:
    """path, rel_path, modified, size, content, language of files under a folder, or of one file.

    Read by Spark's binary source, so that any store that Spark knows will do; filters on size and time reach the source.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    raw = reader.load(root)
    raw = raw.where(F.col("length") <= max_bytes) if max_bytes else raw
    base = root.rstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), "^.*?" + _quoted(base.split("://")[-1].lstrip("/")) + "/*", "")
    rel = F.when(rel == "", text.file_name(F.col("path"))).otherwise(rel)
    own = raw.select("path", rel.alias("rel_path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), F.col("content").cast("string").alias("content"))
    own = own.where(F.size(F.split("rel_path", "/")) <= max_depth) if max_depth else own
    own = own if hidden else own.where(~F.col("rel_path").rlike(r"(^|/)\."))
    own = own.where(text.extension(F.col("rel_path")).isin(*[e.lower().lstrip(".") for e in extensions])) if extensions else own
    own = own.where(text.wanted(F.col("rel_path"), include, exclude)) if include or exclude else own
    return own.withColumn("language", language(F.col("rel_path"), F.col("content")))


def _quoted(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in "/_" else c for c in s)


def sources(spark: SparkSession, root: str) -> DataFrame:
    """Only files of known languages."""
    return scan(spark, root, extensions=tuple(EXTENSIONS))


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Files of both scans by relative path, and those of one side: (rel_path, source, target)."""
    return a.select("rel_path", F.struct("*").alias("source")).join(b.select("rel_path", F.struct("*").alias("target")), "rel_path", "full_outer")


def read_many(spark: SparkSession, root: str, wanted: list[str], max_bytes: int = 10_000_000) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of requested relative paths: those missing or too large are errors, not failures."""
    have = scan(spark, root, hidden=True)
    asked = spark.createDataFrame([(w,) for w in wanted], "rel_path string")
    rows = have.join(F.broadcast(asked), "rel_path", "left_semi").where(F.col("size") <= max_bytes)
    sizes = have.select("rel_path", "size")
    errors = asked.join(sizes, "rel_path", "left").where(F.col("size").isNull() | (F.col("size") > max_bytes)).select("rel_path", F.when(F.col("size").isNull(), "not found").otherwise("too large").alias("error"))
    return rows, errors


def listing(files: DataFrame, folder: str = "") -> DataFrame:
    """One level of a folder: (name, is_dir, n_files, size), folders first, then by name without case."""
    base = folder.rstrip("/") + "/" if folder else ""
    rest = F.substring("rel_path", len(base) + 1, 1 << 30)
    own = files.where(F.col("rel_path").startswith(base)).select(F.substring_index(rest, "/", 1).alias("name"), rest.contains("/").alias("is_dir"), "size")
    return own.groupBy("name", "is_dir").agg(F.count("*").alias("n_files"), F.sum("size").alias("size")).orderBy(F.desc("is_dir"), F.lower("name"))


def tree(files: DataFrame) -> DataFrame:
    """Every folder with its direct children: (folder, children)."""
    parts = F.split("rel_path", "/")
    depth = F.size(parts)
    levels = files.select(F.explode(F.transform(F.sequence(F.lit(1), depth), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i - 1), "/").alias("folder"), F.element_at(parts, i).alias("name"), (i < depth).alias("is_dir")))).alias("x")).select("x.*").distinct()
    return levels.groupBy("folder").agg(F.array_sort(F.collect_list(F.struct((~F.col("is_dir")).alias("is_file"), "name"))).alias("children"))


def modified_text(ts: Column) -> Column:
    """A time as RFC 3339 text in UTC."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
