"""Whole comparisons of two versions: functions of files, names, and their reports.

A Comparison holds lazy tables; ``save`` persists them under an id, ``load`` reads them again, so that no session state is needed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parallax.functions import classify, similarity
from parallax.operators import align, codefront, keyed_diff, matching, names, reports, search
from parallax.operators.candidates import jaccard_pairs, tokens
from parallax.operators.checkpoints import cut


@dataclass(frozen=True)
class Config:
    threshold: float = 0.7
    cross_file_threshold: float = 0.85
    small_body: int = 10
    #: Shared words that a renamed body must keep to be a candidate.
    body_overlap: float = 0.5


@dataclass(frozen=True)
class Comparison:
    """changes: name, change_type, similarity, magnitude, is_unchanged_move, source and target (function rows)."""

    changes: DataFrame

    def summary(self) -> DataFrame:
        return reports.summary(self.changes)

    def changed(self, *, limit: int = 100, types: tuple[str, ...] = (), min_magnitude: float = 0.0) -> DataFrame:
        own = self.changes.where(~F.coalesce("is_unchanged_move", F.lit(False)))
        return keyed_diff.ranked(own, "name", limit=limit, types=types, min_magnitude=min_magnitude)

    def diff(self, name: str) -> DataFrame:
        """Aligned lines of the first change of a name."""
        one = self.changes.where(F.col("name") == name).orderBy("source.file_path", "source.start_line").limit(1)
        return align.line_map(one.select(F.col("name").alias("pair_id"), F.col("source.body").alias("source"), F.col("target.body").alias("target")))

    def save(self, folder: str, comparison_id: str) -> None:
        self.changes.withColumn("created_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{folder}/{comparison_id}")

    @staticmethod
    def load(spark: SparkSession, folder: str, comparison_id: str) -> Comparison:
        return Comparison(spark.read.parquet(f"{folder}/{comparison_id}"))


def function_pairs(a: DataFrame, b: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(a, b, score) of candidate functions, by blocks: equal names, equal bodies, and bodies that share words.

    Scores: same name and file .7 + .3 body; a small body 1 if name and body are equal, else 0; others .3 name + .2 signature + .5 body.
    """
    x, y = a.select(F.col("id").alias("a"), F.struct("*").alias("s")), b.select(F.col("id").alias("b"), F.struct("*").alias("t"))
    by_name = x.join(y, F.col("s.name") == F.col("t.name")).select("a", "b")
    by_body = x.join(y, F.xxhash64("s.body") == F.xxhash64("t.body")).select("a", "b")
    word = r"[A-Za-z_][A-Za-z0-9_]+"
    by_words = jaccard_pairs(tokens(a, "id", F.col("body"), word), tokens(b, "id", F.col("body"), word), cfg.body_overlap).select("a", "b")
    pairs = by_name.unionByName(by_body).unionByName(by_words).distinct().join(x, "a").join(y, "b")
    s, t = F.col("s"), F.col("t")
    body = 0.3 * similarity.count_similarity(s["loc"], t["loc"]) + 0.7 * similarity.char_jaccard(s["body"], t["body"])
    same_file, same_name = s["file_path"] == t["file_path"], s["name"] == t["name"]
    small = F.least(s["loc"], t["loc"]) <= 1
    score = F.when(same_name & same_file, 0.7 + 0.3 * body).when(small, (same_name & (s["body"] == t["body"])).cast("double")).otherwise(0.3 * similarity.name_similarity(s["name"], t["name"]) + 0.2 * similarity.signature_similarity(s, t) + 0.5 * body)
    least = F.when(same_file, cfg.threshold).otherwise(cfg.cross_file_threshold)
    return pairs.withColumn("score", score).where(F.col("score") >= least).select("a", "b", "score")


def compare(a: DataFrame, b: DataFrame, cfg: Config = Config(), *, optimal: bool = False) -> Comparison:
    """Functions of two versions (as codefront.functions gives), matched one to one in order of file, line and name, or at least total cost."""
    def ready(d: DataFrame) -> DataFrame:
        own = codefront.with_measures(d)
        return own.withColumn("id", F.concat_ws("\0", "file_path", F.format_string("%09d", "start_line"), "name"))

    x, y = cut(ready(a)), cut(ready(b))
    pairs = function_pairs(x, y, cfg)
    matched = (matching.optimal(pairs, cfg.threshold) if optimal else matching.greedy_in_order(pairs)).select("a", "b", F.col("score").alias("similarity"))
    left, right = x.select(F.col("id").alias("a"), F.struct("*").alias("source")), y.select(F.col("id").alias("b"), F.struct("*").alias("target"))
    both = left.join(matched, "a", "left").join(right, "b", "full_outer")
    s, t = F.col("source"), F.col("target")
    same_file, same_name = s["file_path"] == t["file_path"], s["name"] == t["name"]
    equal = same_file & same_name & (s["body"] == t["body"])
    kind = F.when(s.isNull(), "added").when(t.isNull(), "deleted").when(equal, "same").otherwise(classify.report_type(same_file, same_name))
    own = both.select(F.coalesce(s["name"], t["name"]).alias("name"), kind.alias("change_type"), "similarity", F.when(s.isNotNull() & t.isNotNull(), classify.is_unchanged_move(same_file, same_name, F.col("similarity"))).alias("is_unchanged_move"), "source", "target")
    return Comparison(keyed_diff.with_magnitude(own))


def compare_folders(spark: SparkSession, source: str, target: str, cfg: Config = Config(), **scan_options) -> Comparison:
    from parallax.sources.files import scan

    def functions(root: str) -> DataFrame:
        files = scan(spark, root, **scan_options)
        return codefront.functions(files.select(F.col("rel_path").alias("path"), "content"))

    return compare(functions(source), functions(target), cfg)


@dataclass(frozen=True)
class NameComparison:
    """Two catalogues of named functions. matches: a, b, score, confidence, phase; added, deleted: id, name, ..."""

    a: DataFrame
    b: DataFrame
    matches: DataFrame
    added: DataFrame
    deleted: DataFrame

    def list_matches(self, *, limit: int = 1000, min_similarity: float = 0.0) -> DataFrame:
        return self.matches.where(F.col("score") >= min_similarity).orderBy("score", "a").limit(limit)

    def summary(self) -> DataFrame:
        return reports.statistics(self.matches, self.added, self.deleted)

    def distribution(self) -> DataFrame:
        return reports.score_distribution(self.matches)

    def list_all(self, *, query: str | None = None, sort_by: str = "name", limit: int = 1000) -> DataFrame:
        m = self.matches.join(self.a.select(F.col("id").alias("a"), "name", "address"), "a").select("name", "address", F.col("score").alias("similarity"))
        none = lambda d: d.select("name", "address", F.lit(None).cast("double").alias("similarity"))
        return search.listed(m, none(self.added), none(self.deleted), query=query, sort_by=sort_by, limit=limit)

    def suggest(self, name: str) -> DataFrame:
        return names.suggestions(self.a.select("name").unionByName(self.b.select("name")).distinct(), name)

    def _code_pairs(self) -> DataFrame:
        return self.matches.join(self.a.select(F.col("id").alias("a"), "name", F.col("code").alias("source")), "a").join(self.b.select(F.col("id").alias("b"), F.col("code").alias("target")), "b").select(F.col("name").alias("pair_id"), "source", "target")

    def diff(self, name: str) -> DataFrame:
        return align.line_map(self._code_pairs().where(F.col("pair_id") == name))

    def analyse(self, name: str) -> dict[str, DataFrame]:
        """Constants, calls, argument numbers and control flow of one matched function."""
        own = self._code_pairs().where(F.col("pair_id") == name)
        return {"constants": search.set_differences(own, search.constants), "calls": search.set_differences(own, search.calls), "arguments": search.argument_drift(own), "control_flow": own.select("pair_id", search.control_flow(F.col("source")).alias("source"), search.control_flow(F.col("target")).alias("target"))}


def compare_names(a: DataFrame, b: DataFrame, threshold: float = 0.7) -> NameComparison:
    """a, b: id, name, address, code."""
    return NameComparison(a, b, *names.match_names(a, b, threshold))
