"""Refactoring patterns from groups of related changes.

changes: change_id, change_type (add, delete, modify, rename, move, cross_file_move), source and target (name, file_path, start_line,
element_type, signature), similarity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallax.operators.names import alike_names

NEAR_LINES, NEAR_NAMES, SOME_NAMES = 50, 0.7, 0.5
LEAST_CONFIDENCE = 0.7


def near_lines(changes: DataFrame) -> DataFrame:
    """(seed, member) of changes in one file within some lines; the seed has the smaller id. Blocked by file and buckets of lines."""
    own = changes.select("change_id", F.coalesce("source", "target").alias("e"))
    bucket = F.floor(F.col("e.start_line") / (NEAR_LINES + 1))
    x = own.select(F.col("change_id").alias("seed"), F.col("e.start_line").alias("p"), bucket.alias("k"), F.col("e.file_path").alias("f"))
    y = own.select(F.col("change_id").alias("member"), F.col("e.start_line").alias("q"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("k"), F.col("e.file_path").alias("f"))
    return x.join(y, ["f", "k"]).where("seed < member").where(F.abs(F.col("p") - F.col("q")) <= NEAR_LINES).select("seed", "member")


def clusters(changes: DataFrame) -> DataFrame:
    """(change_id, cluster): in order of ids, a free change becomes a seed and takes all free later changes related to it; not transitive.

    Related are changes near by in one file, with alike names in any files (edit similarity over .7), and additions and deletions
    with somewhat alike names (over .5). Run in rounds over what is live, free changes and seeds: a free change without a smaller live relative is a seed, one whose
    smallest is a seed joins it. Relatives by name are found through the smallest live id of each name, never as pairs of changes.
    """
    from parallax.operators.checkpoints import cut

    own = cut(changes.select("change_id", F.coalesce("source.name", "target.name").alias("name"), F.when(F.col("change_type").isin("add", "delete"), F.col("change_type")).alias("kind")))
    pairs = cut(near_lines(changes).distinct())
    of = lambda kind: own.where(F.col("kind") == kind)
    some = alike_names(of("add"), of("delete"), SOME_NAMES)
    to_delete = some.select("x", F.lit("add").alias("kind_x"), "y", F.lit("delete").alias("kind_y"))
    to_add = some.select(F.col("y").alias("x"), F.lit("delete").alias("kind_x"), F.col("x").alias("y"), F.lit("add").alias("kind_y"))
    every = alike_names(own, own, NEAR_NAMES).unionByName(own.where("name is not null").select(F.col("name").alias("x"), F.col("name").alias("y"))).distinct()
    any_kind = every.select("x", F.lit(None).cast("string").alias("kind_x"), "y", F.lit(None).cast("string").alias("kind_y"))
    alike = cut(any_kind.unionByName(to_delete).unionByName(to_add))
    with_kinds = lambda d: d.where("name is not null").select("name", F.explode(F.array_distinct(F.array(F.lit(None).cast("string"), "kind"))).alias("kind"), "change_id")
    left, live, done = own, own, None  # live: free changes, and seeds, which later rounds may still join
    while not left.isEmpty():
        # The smallest live id of each name, of all kinds (null) and of each.
        low = with_kinds(live).groupBy("name", "kind").agg(F.min("change_id").alias("low"))
        named = alike.join(low, (F.col("y") == F.col("name")) & F.col("kind_y").eqNullSafe(F.col("kind"))).groupBy("x", "kind_x").agg(F.min("low").alias("low"))
        by_name = with_kinds(left).join(named, (F.col("name") == F.col("x")) & F.col("kind").eqNullSafe(F.col("kind_x"))).select("change_id", "low")
        by_line = pairs.join(left.select(F.col("change_id").alias("member")), "member", "left_semi").join(live.select(F.col("change_id").alias("seed")), "seed", "left_semi").select(F.col("member").alias("change_id"), F.col("seed").alias("low"))
        first = cut(left.select("change_id", F.col("change_id").alias("low")).unionByName(by_name).unionByName(by_line).groupBy("change_id").agg(F.min("low").alias("low")))
        new = first.where("low = change_id").select(F.col("change_id").alias("low"))
        seeds = new if done is None else new.unionByName(done.where("change_id = cluster").select(F.col("cluster").alias("low")))
        now = cut(first.join(seeds, "low", "left_semi").select("change_id", F.col("low").alias("cluster")))
        done = cut(now if done is None else done.unionByName(now))
        left = cut(left.join(now, "change_id", "left_anti"))
        live = cut(live.join(now.where("change_id <> cluster"), "change_id", "left_anti"))
    return done if done is not None else left.select("change_id", F.col("change_id").alias("cluster"))


def _pairs(own: DataFrame, first: Column, second: Column) -> DataFrame:
    """Pairs of changes (x, y) of one cluster, of two kinds."""
    row = F.struct("change_id", "change_type", "source", "target", "similarity")
    x = own.where(first).select("cluster", row.alias("x"))
    y = own.where(second).select("cluster", row.alias("y"))
    return x.join(y, "cluster").where("x.change_id <> y.change_id")


def _telling(a: Column, b: Column) -> Column:
    """Names with a word of more than three letters in common, or a later name that says that it helps."""
    words = lambda c: F.filter(F.split(F.lower(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1_$2")), "_"), lambda w: F.length(w) > 3)
    return F.arrays_overlap(words(a), words(b)) | b.rlike("(?i)(helper|validate|process|handle|compute|calculate|extract|check)")


def _extracted(named: Column, near: Column, same_file: Column, similar: Column) -> Column:
    return 0.4 + 0.2 * named.cast("double") + 0.1 * near.cast("double") + 0.2 * same_file.cast("double") + 0.1 * similar.cast("double")


def _inlined(near: Column, same_file: Column, similar: Column) -> Column:
    return 0.4 + 0.3 * same_file.cast("double") + 0.1 * near.cast("double") + 0.2 * similar.cast("double")


def extract_method(own: DataFrame) -> DataFrame:
    """A modified function beside an added one: .4, +.2 for a shared word in the names, +.2 same file, +.1 near, +.1 similarity over .7."""
    p = _pairs(own, F.col("change_type") == "modify", F.col("change_type") == "add")
    a, b = F.col("x.source"), F.col("y.target")
    score = _extracted(_telling(a["name"], b["name"]), F.abs(a["start_line"] - b["start_line"]) <= NEAR_LINES, a["file_path"] == b["file_path"], F.col("x.similarity") > 0.7)
    return p.select("cluster", F.lit("extract_method").alias("pattern"), F.array("x.change_id", "y.change_id").alias("change_ids"), score.alias("confidence"))


def inline_method(own: DataFrame) -> DataFrame:
    """A modified function beside a deleted one."""
    p = _pairs(own, F.col("change_type") == "modify", F.col("change_type") == "delete")
    a, b = F.col("x.source"), F.col("y.source")
    score = _inlined(F.abs(a["start_line"] - b["start_line"]) <= NEAR_LINES, a["file_path"] == b["file_path"], F.col("x.similarity") > 0.5)
    return p.select("cluster", F.lit("inline_method").alias("pattern"), F.array("x.change_id", "y.change_id").alias("change_ids"), score.alias("confidence"))


def single(own: DataFrame) -> DataFrame:
    """Renames, moves and changed signatures, one change each."""
    kind = F.when(F.col("change_type") == "rename", "rename").when(F.col("change_type").isin("move", "cross_file_move"), "move_method").when((F.col("change_type") == "modify") & ~F.col("source.signature").eqNullSafe(F.col("target.signature")), "change_signature")
    return own.withColumn("pattern", kind).where("pattern is not null").select("cluster", "pattern", F.array("change_id").alias("change_ids"), F.coalesce("similarity", F.lit(0.8)).alias("confidence"))


def class_patterns(own: DataFrame) -> DataFrame:
    """An added (deleted) class beside changed functions of its cluster was extracted (inlined)."""
    rows = own.groupBy("cluster").agg(F.count_if((F.col("change_type") == "add") & (F.col("target.element_type") == "class")).alias("new"), F.count_if((F.col("change_type") == "delete") & (F.col("source.element_type") == "class")).alias("gone"), F.count_if(F.col("change_type").isin("modify", "move", "cross_file_move")).alias("changed"), F.array_sort(F.collect_list("change_id")).alias("change_ids"))
    pattern = F.when((F.col("new") > 0) & (F.col("changed") > 0), "extract_class").when((F.col("gone") > 0) & (F.col("changed") > 0), "inline_class")
    return rows.withColumn("pattern", pattern).where("pattern is not null").select("cluster", "pattern", "change_ids", F.least(F.lit(1.0), 0.6 + 0.1 * F.col("changed")).alias("confidence"))


def complex_patterns(own: DataFrame) -> DataFrame:
    """Clusters of at least three changes of at least two kinds, at .6."""
    rows = own.groupBy("cluster").agg(F.count("*").alias("n"), F.count_distinct("change_type").alias("kinds"), F.array_sort(F.collect_list("change_id")).alias("change_ids"))
    return rows.where("n >= 3 and kinds >= 2").select("cluster", F.lit("complex").alias("pattern"), "change_ids", F.lit(0.6).alias("confidence"))


def patterns(changes: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """(cluster, pattern, change_ids, confidence) at or above the least confidence, highest first."""
    own = changes.join(clusters(changes), "change_id")
    found = extract_method(own).unionByName(inline_method(own)).unionByName(single(own)).unionByName(class_patterns(own)).unionByName(complex_patterns(own))
    return found.where(F.col("confidence") >= least).orderBy(F.desc("confidence"), "cluster", "pattern")


def _numbers(own: DataFrame, second: str, side: str, above: float, *, names: bool) -> DataFrame:
    """(name_a, name_b, similar, same_file, near, n): how many pairs of a modified function and a change of another kind share a cluster.

    Pairs are counted, not made: as products of the numbers of either side, and those of one file, near by, or of one id are taken from
    where they count by default. Rows that lack what a score needs have none.
    """
    keys = ["name"] if names else []
    lines = lambda d, s, *more: d.select("cluster", "change_id", *[F.col(f"{s}.{k}").alias(k) for k in ("name", "file_path", "start_line")], *more).where("file_path is not null and start_line is not null")
    x = lines(own.where("change_type = 'modify' and similarity is not null"), "source", (F.col("similarity") > above).alias("similar"))
    y = lines(own.where(F.col("change_type") == second), side)
    numbers = lambda d, s, *by: d.groupBy("cluster", *by, *[F.col(k).alias(f"{k}_{s}") for k in keys]).agg(F.count("*").alias(f"n_{s}"))

    def cells(d: DataFrame, n: Column, *signs: tuple[Column, Column, int]) -> DataFrame:
        cell = F.explode(F.array(*[F.struct(same.alias("same_file"), near.alias("near"), (n * sign).alias("n")) for same, near, sign in signs]))
        named = [F.col(f"{k}_{s}") if names else F.lit(None).cast("string").alias(f"{k}_{s}") for k in ("name",) for s in "ab"]
        return d.select(*named, "similar", cell.alias("c")).select("name_a", "name_b", "similar", "c.*").groupBy("name_a", "name_b", "similar", "same_file", "near").agg(F.sum("n").alias("n"))

    def near(*by: str) -> DataFrame:
        bucket = F.floor(F.col("start_line") / (NEAR_LINES + 1))
        p = numbers(x, "a", *by, "start_line", "similar").withColumn("k", bucket).withColumnRenamed("start_line", "p")
        q = numbers(y, "b", *by, "start_line").withColumn("k", F.explode(F.array(bucket - 1, bucket, bucket + 1))).withColumnRenamed("start_line", "q")
        return p.join(q, ["cluster", *by, "k"]).where(F.abs(F.col("p") - F.col("q")) <= NEAR_LINES)

    yes, no, n = F.lit(True), F.lit(False), F.col("n_a") * F.col("n_b")
    out = cells(numbers(x, "a", "similar").join(numbers(y, "b"), "cluster"), n, (no, no, 1))
    out = out.unionByName(cells(numbers(x, "a", "file_path", "similar").join(numbers(y, "b", "file_path"), ["cluster", "file_path"]), n, (yes, no, 1), (no, no, -1)))
    out = out.unionByName(cells(near(), n, (no, yes, 1), (no, no, -1)))
    out = out.unionByName(cells(near("file_path"), n, (yes, yes, 1), (yes, no, -1), (no, yes, -1), (no, no, 1)))
    own_id = x.select("cluster", "change_id", "similar", *[F.col(k).alias(f"{k}_a") for k in ("name", "file_path", "start_line")]).join(y.select("cluster", "change_id", *[F.col(k).alias(f"{k}_b") for k in ("name", "file_path", "start_line")]), ["cluster", "change_id"])
    out = out.unionByName(cells(own_id, F.lit(1), (F.col("file_path_a") == F.col("file_path_b"), F.abs(F.col("start_line_a") - F.col("start_line_b")) <= NEAR_LINES, -1)))
    return out.groupBy("name_a", "name_b", "similar", "same_file", "near").agg(F.sum("n").alias("n")).where("n > 0")


def totals(changes: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """(pattern, n, mean_confidence) of ``patterns``, without a row for each pair of changes of a cluster."""
    from parallax.operators.checkpoints import cut

    own = cut(changes.join(clusters(changes), "change_id"))
    flags = [F.col(c) for c in ("near", "same_file", "similar")]
    rows = _numbers(own, "add", "target", 0.7, names=True).select(F.lit("extract_method").alias("pattern"), _extracted(_telling(F.col("name_a"), F.col("name_b")), *flags).alias("confidence"), "n")
    rows = rows.unionByName(_numbers(own, "delete", "source", 0.5, names=False).select(F.lit("inline_method").alias("pattern"), _inlined(*flags).alias("confidence"), "n"))
    for d in (single(own), class_patterns(own), complex_patterns(own)):
        rows = rows.unionByName(d.select("pattern", "confidence", F.lit(1).cast("long").alias("n")))
    sums = rows.where(F.col("confidence") >= least).groupBy("pattern").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("confidence")).alias("s"))
    return sums.select("pattern", "n", (F.col("s") / F.col("n")).alias("mean_confidence"))


def exclusive(found: DataFrame) -> DataFrame:
    """At most one pattern of each cluster: the surest, then the first by name."""
    return found.groupBy("cluster").agg(F.min_by(F.struct("pattern", "change_ids", "confidence"), F.struct(-F.col("confidence"), "pattern")).alias("x")).select("cluster", "x.*")
