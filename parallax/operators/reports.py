"""Summaries, histograms and rendered reports of changes and matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallax.functions import classify, text

KINDS = ("added", "deleted", "modified", "renamed", "moved")


def summary(changes: DataFrame) -> DataFrame:
    """One row: counts by kind, sizes of both sides, the larger of them as total, and what did not change."""
    count = [F.count_if(F.col("change_type") == k).alias(f"n_{k}") for k in KINDS]
    own = changes.agg(*count, F.count("source").alias("n_source"), F.count("target").alias("n_target"))
    total = F.greatest("n_source", "n_target")
    changed = sum((F.col(f"n_{k}") for k in KINDS[1:]), F.col("n_added"))
    return own.withColumn("n_total", total).withColumn("n_unchanged", F.greatest(F.lit(0).cast("long"), total - changed))


def statistics(matches: DataFrame, added: DataFrame, deleted: DataFrame) -> DataFrame:
    """n_matched, n_modified (score under 1), avg_score, n_added, n_removed, n_compared."""
    m = matches.agg(F.count("*").alias("n_matched"), F.count_if(F.col("score") < 1).alias("n_modified"), F.avg("score").alias("avg_score"))
    own = m.crossJoin(added.agg(F.count("*").alias("n_added"))).crossJoin(deleted.agg(F.count("*").alias("n_removed")))
    return own.withColumn("n_compared", F.col("n_matched") + F.col("n_added") + F.col("n_removed"))


def overall_similarity(changes: DataFrame) -> DataFrame:
    """Matched share times one less the mean penalty of the changes; 1 without changes. changes: change_type, matched (boolean)."""
    own = changes.agg(F.count("*").alias("n_total"), F.count_if("matched").alias("n_matched"), F.count_if(F.col("change_type") != "same").alias("n_changes"), F.avg(F.when(F.col("change_type") != "same", classify.penalty(F.col("change_type")))).alias("mean_penalty"))
    score = F.when(F.col("n_changes") == 0, 1.0).otherwise(F.col("n_matched") / F.col("n_total") * (1 - F.col("mean_penalty")))
    return own.withColumn("similarity", score)


def histogram(changes: DataFrame, *by: str) -> DataFrame:
    return changes.groupBy(*(by or ("change_type",))).agg(F.count("*").alias("n"))


def rollup(changes: DataFrame, *by: str) -> DataFrame:
    """Counts by each prefix of the columns; grouping tells totals from null values."""
    return changes.rollup(*by).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def score_distribution(matches: DataFrame) -> DataFrame:
    """n, avg_score, buckets, and the ids of the most and the least similar pair."""
    b = classify.similarity_bucket(F.col("score"))
    return matches.agg(F.count("*").alias("n"), F.avg("score").alias("avg_score"), *[F.count_if(b == k).alias(f"n_{k}") for k in ("high", "medium", "low")], F.max_by("a", F.struct("score", -F.col("a"))).alias("most_similar"), F.min_by("a", F.struct("score", "a")).alias("least_similar"))


def per_file(moves: DataFrame) -> DataFrame:
    """(file, moved_out, moved_in) of moves (from_file, to_file)."""
    rows = moves.select(F.col("from_file").alias("file"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(moves.select(F.col("to_file").alias("file"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return rows.groupBy("file").agg(F.sum("o").alias("moved_out"), F.sum("i").alias("moved_in"))


def complexity_buckets(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(classify.complexity_bucket(F.col(column)).alias("bucket")).agg(F.count("*").alias("n"))


def by_extension(df: DataFrame, path: str) -> DataFrame:
    return df.groupBy(F.coalesce(text.extension(F.col(path)), F.lit("none")).alias("extension")).agg(F.count("*").alias("n"))


def weighted_similarity(df: DataFrame, weight: str, score: str) -> DataFrame:
    return df.agg((F.sum(F.col(score) * F.col(weight)) / F.sum(weight)).alias("weighted_similarity"))


def merged_stats(stats: DataFrame) -> DataFrame:
    """Per-file figures rolled up (n_files, n_changes, avg_similarity, total_ms)."""
    return stats.agg(F.count("*").alias("n_files"), F.sum("changes").alias("n_changes"), F.avg("similarity").alias("avg_similarity"), F.sum("processing_time_ms").alias("total_ms"))


def insights(summary_row: DataFrame) -> DataFrame:
    """Sentences that follow from a summary."""
    share = F.col("n_modified") / F.greatest(F.lit(1), F.col("n_total"))
    said = F.array_compact(F.array(F.when(share > 0.5, F.lit("more than half of all rows were modified")), F.when(F.col("n_added") > 2 * F.col("n_deleted"), F.lit("growth: many more rows were added than deleted")), F.when(F.col("n_renamed") > F.col("n_modified"), F.lit("naming: more rows were renamed than modified")), F.when(F.col("n_unchanged") == F.col("n_total"), F.lit("nothing changed")), F.format_string("%.1f%% of all rows changed", 100 * (F.col("n_total") - F.col("n_unchanged")) / F.greatest(F.lit(1), F.col("n_total")))))
    return summary_row.select(F.explode(said).alias("insight"))


def csv_lines(report: DataFrame) -> DataFrame:
    """Rows of a comparison report as CSV text: source_file, target_file, language, similarity (six places), changes, refactoring_patterns, processing_time_ms."""
    cells = [text.csv_cell(F.col("source_file")), text.csv_cell(F.col("target_file")), F.col("language"), F.format_string("%.6f", "similarity"), F.col("changes").cast("string"), F.col("refactoring_patterns").cast("string"), F.col("processing_time_ms").cast("string")]
    return report.select(F.concat_ws(",", *cells).alias("line"))


CSV_HEADER = "source_file,target_file,language,similarity,changes,refactoring_patterns,processing_time_ms"


def write_csv(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").option("header", True).csv(path)


def write_json(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def json_rows(report: DataFrame) -> DataFrame:
    return report.select(F.to_json(F.struct("*")).alias("json"))


def render(report: DataFrame, style: str = "text", limit: int = 1000) -> str:
    """A small report as text, markdown, html or xml; the limit bounds what the driver holds."""
    cols = report.columns
    rows = [[("" if r[c] is None else str(r[c])) for c in cols] for r in report.limit(limit).toLocalIterator()]
    esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
    if style == "markdown":
        return "\n".join(["| " + " | ".join(cols) + " |", "|" + "---|" * len(cols), *["| " + " | ".join(x.replace("|", "\\|") for x in r) + " |" for r in rows]])
    if style == "html":
        return "<table><tr>" + "".join(f"<th>{esc(c)}</th>" for c in cols) + "</tr>" + "".join("<tr>" + "".join(f"<td>{esc(x)}</td>" for x in r) + "</tr>" for r in rows) + "</table>"
    if style == "xml":
        return "<report>" + "".join("<row>" + "".join(f"<{c}>{esc(x)}</{c}>" for c, x in zip(cols, r)) + "</row>" for r in rows) + "</report>"
    return "\n".join("  ".join(f"{c}={x}" for c, x in zip(cols, r)) for r in rows)
