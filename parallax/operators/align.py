"""Line alignment of pairs of texts, hunks and unified output.

The alignment itself works on one pair at a time, inside a pandas function: of its table (a cell for each pair of lines
between the equal ends) only some rows are kept, and those between them are computed again on the way back, so that n lines against m take
memory for about 2 m sqrt(n) cells. Everything after it is relational.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parallax.functions.classify import line_tags

#: Lines that a task gives out at once.
ROWS_AT_ONCE = 20_000
LINE_MAP = "pair_id string, idx long, change_type string, source_line int, target_line int, source_content string, target_content string, similarity double"


def split_lines(text: str | None) -> list[str]:
    body = (text or "").replace("\r\n", "\n")
    body = body[:-1] if body.endswith("\n") else body
    return body.split("\n") if text else []


def line_score(a: str, b: str) -> float:
    """Equal characters at equal places over the longer, times shorter over longer length, of trimmed lines."""
    a, b = a.strip(), b.strip()
    if a == b:
        return 1.0
    least, most = sorted((len(a), len(b)))
    return sum(x == y for x, y in zip(a, b)) / most * (least / most) if least else 0.0


class Table:
    """Lengths of longest common subsequences of the first i of p and the first j of q, of which every so many rows are kept."""

    def __init__(self, p: np.ndarray, q: np.ndarray):
        self.p, self.q, self.every = p, q, max(1, math.isqrt(len(p)))
        self.kept, self.block, self.first = [np.zeros(len(q) + 1, dtype=np.int32)], [], 0
        row = self.kept[0]
        for i in range(1, len(p) + 1):
            row = self._next(row, i)
            if i % self.every == 0:
                self.kept.append(row)

    def _next(self, above: np.ndarray, i: int) -> np.ndarray:
        # The best of going on from a match and of the row above, carried along the row.
        row = np.zeros_like(above)
        np.maximum.accumulate(np.maximum(above[1:], above[:-1] + (self.q == self.p[i - 1])), out=row[1:])
        return row

    def row(self, i: int) -> np.ndarray:
        """Row i. Rows asked for from the last to the first are computed once more each."""
        if not self.block or not self.first <= i < self.first + len(self.block):
            # The row after the block is wanted together with the block's last one.
            self.first = max(0, (i - 1) // self.every * self.every)
            self.block = [self.kept[self.first // self.every]]
            while self.first + len(self.block) <= min(len(self.p), self.first + self.every):
                self.block.append(self._next(self.block[-1], self.first + len(self.block)))
        return self.block[i - self.first]


def align(a: list[str], b: list[str], *, replace: bool = True) -> list[tuple[str, int | None, int | None]]:
    """(kind, place in a, place in b) along a longest common subsequence, from the start.

    Where neither side's line is common, similar lines (over .3) become one replaced line; else insertions come last.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    number: dict[str, int] = {}
    p = np.array([number.setdefault(s, len(number)) for s in x], dtype=np.int64)
    q = np.array([number.setdefault(s, len(number)) for s in y], dtype=np.int64)
    table = Table(p, q)
    out: list[tuple[str, int | None, int | None]] = []
    i, j = len(x), len(y)
    while i or j:
        if i and j and p[i - 1] == q[j - 1]:
            out.append(("unchanged", head + i - 1, head + j - 1))
            i, j = i - 1, j - 1
        elif i and j and replace and table.row(i - 1)[j] == table.row(i)[j - 1] and line_score(x[i - 1], y[j - 1]) > 0.3:
            out.append(("modified", head + i - 1, head + j - 1))
            i, j = i - 1, j - 1
        elif j and (not i or table.row(i)[j - 1] >= table.row(i - 1)[j]):
            out.append(("added", None, head + j - 1))
            j -= 1
        else:
            out.append(("deleted", head + i - 1, None))
            i -= 1
    middle = out[::-1]
    first = [("unchanged", k, k) for k in range(head)]
    last = [("unchanged", len(a) - tail + k, len(b) - tail + k) for k in range(tail)]
    return first + middle + last


def align_ahead(a: list[str], b: list[str], window: int = 10) -> list[tuple[str, int | None, int | None]]:
    """A quick variant: at a difference the nearest equal line within a window ahead ends it."""
    out: list[tuple[str, int | None, int | None]] = []
    i = j = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append(("unchanged", i, j))
            i, j = i + 1, j + 1
            continue
        step = next((n for n in range(1, 2 * window) for k in range(n + 1) if i + k < len(a) and j + n - k < len(b) and k <= window and n - k <= window and a[i + k] == b[j + n - k]), None)
        k = 1 if step is None else next(k for k in range(step + 1) if i + k < len(a) and j + step - k < len(b) and k <= window and step - k <= window and a[i + k] == b[j + step - k])
        m = 1 if step is None else step - k
        out += [("deleted", i + n, None) for n in range(k)] + [("added", None, j + n) for n in range(m)]
        i, j = i + k, j + m
    return out + [("deleted", n, None) for n in range(i, len(a))] + [("added", None, n) for n in range(j, len(b))]


def prepared(text: Column, *, trim: bool = False, lower: bool = False) -> Column:
    """A text whose lines are trimmed or lower-cased before they are compared."""
    own = F.array_join(F.transform(F.split(text, "\n"), F.trim), "\n") if trim else text
    return F.lower(own) if lower else own


def line_map(pairs: DataFrame, *, mode: str = "lcs") -> DataFrame:
    """Aligned lines of each pair (pair_id, source, target): a row each, with places from 1 and similarity of both lines.

    mode: lcs (with replaced lines), plain (without) or ahead.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["pair_id", "idx", "change_type", "source_line", "target_line", "source_content", "target_content", "similarity"]
        frame = lambda rows: pd.DataFrame(rows, columns=columns).astype({"source_line": "Int32", "target_line": "Int32", "idx": "int64"})
        rows: list[tuple] = []
        for pdf in batches:
            for pair, s, t in zip(pdf["pair_id"], pdf["source"], pdf["target"]):
                a, b = split_lines(s), split_lines(t)
                steps = align_ahead(a, b) if mode == "ahead" else align(a, b, replace=mode == "lcs")
                rows += [(pair, k, kind, None if i is None else i + 1, None if j is None else j + 1, None if i is None else a[i], None if j is None else b[j], line_score(a[i], b[j]) if i is not None and j is not None else None) for k, (kind, i, j) in enumerate(steps)]
                if len(rows) >= ROWS_AT_ONCE:
                    yield frame(rows)
                    rows = []
        if rows:
            yield frame(rows)

    return pairs.select(F.col("pair_id").cast("string").alias("pair_id"), "source", "target").mapInPandas(run, LINE_MAP)


def tagged(lines: DataFrame) -> DataFrame:
    """Modified lines with what flipped in them."""
    return lines.withColumn("semantic", F.when(F.col("change_type") == "modified", line_tags(F.col("source_content"), F.col("target_content"))))


def with_node_types(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """The last node type of each target line (nodes: pair_id, line, node_type, pre), and whether the change is structural."""
    last = nodes.groupBy("pair_id", F.col("line").alias("target_line")).agg(F.max_by("node_type", "pre").alias("node_type"))
    structural = F.col("node_type").isin("Function", "Method", "Class", "Interface", "IfStatement", "ForLoop", "WhileLoop", "element") & (F.col("change_type") != "unchanged")
    return lines.join(last, ["pair_id", "target_line"], "left").withColumn("structural", F.coalesce(structural, F.lit(False)))


def statistics(lines: DataFrame) -> DataFrame:
    kinds = ("unchanged", "modified", "added", "deleted")
    return lines.groupBy("pair_id").agg(*[F.count_if(F.col("change_type") == k).alias(f"n_{k}") for k in kinds], F.count("*").alias("n_lines"))


def hunks(lines: DataFrame, context: int = 3) -> DataFrame:
    """Lines near a change, with the number of their hunk: hunks are runs of lines at most ``context`` from a change."""
    w = W.partitionBy("pair_id").orderBy("idx")
    changed = F.when(F.col("change_type") != "unchanged", F.col("idx"))
    before, after = F.last(changed, True).over(w), F.first(changed, True).over(w.rowsBetween(0, W.unboundedFollowing))
    near = (F.coalesce(F.col("idx") - before, F.lit(1 << 40)) <= context) | (F.coalesce(after - F.col("idx"), F.lit(1 << 40)) <= context)
    own = lines.withColumn("__near", near).where("__near")
    gap = F.coalesce((F.col("idx") - F.lag("idx").over(w) > 1).cast("int"), F.lit(0))
    return own.withColumn("__gap", gap).withColumn("hunk", F.sum("__gap").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__near", "__gap")


def unified(lines: DataFrame, context: int = 3) -> DataFrame:
    """(pair_id, hunk, header, body) of unified output; a hunk's body is bounded by the pair's own lines."""
    own = hunks(lines, context)
    mark = F.when(F.col("change_type") == "unchanged", F.array(F.concat(F.lit(" "), "source_content")))
    mark = mark.when(F.col("change_type") == "modified", F.array(F.concat(F.lit("-"), "source_content"), F.concat(F.lit("+"), "target_content")))
    mark = mark.when(F.col("change_type") == "added", F.array(F.concat(F.lit("+"), "target_content"))).otherwise(F.array(F.concat(F.lit("-"), "source_content")))
    made = own.groupBy("pair_id", "hunk").agg(F.min("source_line").alias("a"), F.count("source_line").alias("n"), F.min("target_line").alias("b"), F.count("target_line").alias("m"), F.array_sort(F.collect_list(F.struct("idx", mark.alias("t")))).alias("rows"))
    header = F.format_string("@@ -%d,%d +%d,%d @@", F.coalesce("a", F.lit(0)), "n", F.coalesce("b", F.lit(0)), "m")
    return made.select("pair_id", "hunk", header.alias("header"), F.array_join(F.flatten(F.transform("rows", lambda r: r["t"])), "\n").alias("body"))
