"""Personal data by candidate gradient boosting, in DataFrame functions only.

Strict patterns give the base spans, which always stay. High-recall generators propose further, overlapping spans: addresses
with any letters, numbers in any grouping, dotted quads with brackets, long strings of letters and digits. Small binned features of
their format and context are counted over all documents, and boosted trees are
grown on those counts (cells of equal features, never rows). The trees become a SQL expression. A threshold for each
generator is the lowest whose held-back candidates are right often enough; a generator without such a threshold adds nothing.

Candidates count as right, for training, by weak rules that are not the strict patterns: the layout of a card number, whatever
its check digit; a phone's groups, or a cue word before fewer of them; four parts that fit an address, however dotted; letters before and a named domain
after an at sign; a long string after a cue or a sign of assignment.

Defined cases: a null text is empty and has no spans; offsets are code points; base matches that fail validation are
dropped, without a second try; added spans that overlap a base span are left out; repeated rows are judged alike;
an empty table gives a model that adds nothing. Extra columns are ignored (``redact`` keeps them, whatever their names).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallax.llm.common import fresh

KINDS = ("email", "ip", "card", "phone")
#: Kinds of added spans; the last has no strict pattern.
NAMES = (*KINDS, "secret")
#: Possessive forms of the strict patterns. A match begins where a run begins or where the last match ended.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried: cheaper to look for than the pattern, and part of each valid match.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9](?:[ -]?[0-9]){15}", "phone": r"\+[0-9]"}
_PART = r"0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
IP_PARTS = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"
#: Generators of candidates, wider than the strict patterns.
WIDE = {
    "address": r"(?:(?<![^\s@<>,;])|\G)[^\s@<>,;]++@[^\s@<>,;]++",
    "number": r"(?:\+|\()?[0-9](?:[ ().\-/]{0,2}[0-9])++",
    "quad": r"(?:(?<![0-9.])|\G)[0-9]{1,4}+(?:[ \[(]{0,2}\.[ \])]{0,2}[0-9]{1,4}+){3}",
    "secret": r"(?:(?<![A-Za-z0-9_+/=-])|\G)[A-Za-z0-9_+/=-]{20,}+",
}
WIDE_NEEDS = {"address": "@", "number": r"[0-9](?:[ ().\-/]{0,2}[0-9]){6}", "quad": r"[0-9][ \[(]{0,2}\.[ \])]{0,2}[0-9]", "secret": "(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20}"}
CONTEXT = 24
CUES = r"(?i)(?:mail|contact|write|phone|tel|call|fax|mobile|card|visa|account|pay|token|secret|key|passw|bearer)"
PRECISION = 0.98
TREES, DEPTH, RATE = 24, 3, 0.3
FEATURES = ("gen", "digits", "plus", "seps", "paren", "before", "after", "cue", "dots", "lead", "mix")
#: Matches of a text whose offsets are summed at a time.
STRETCH = 256


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(IP_PARTS)
    if kind == "card":
        d = _digits(m)
        return (F.length(d) >= 16) & (F.length(d) <= 19) & luhn(d)
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def _once(value: Column, use) -> Column:
    """use(value) with the value computed a single time, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _matches(text: Column, pattern: str, need: str) -> Column:
    """Spans (m, s, e) of all matches: lengths of what lies between them, and of themselves, summed from the left."""
    none = F.expr("cast(array() as array<struct<m:string,s:int,e:int>>)")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["b"])
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(x["m"].alias("m"), s.alias("s"), e.alias("e")))).alias("out"))

    def summed(both: Column) -> Column:
        def stretch(acc: Column, k: Column) -> Column:  # so that a growing array is not copied for each of many matches
            own = F.aggregate(F.slice(both, k * STRETCH + 1, F.lit(STRETCH)), F.struct(acc["at"].alias("at"), none.alias("out")), step)
            return _once(own, lambda o: F.struct(o["at"].alias("at"), F.concat(acc["out"], o["out"]).alias("out")))

        return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(both) - 1) / STRETCH).cast("int")), start, stretch, lambda acc: acc["out"])

    def located(found: Column) -> Column:  # texts are split only where there is a match
        both = F.zip_with(found, F.slice(F.split(text, pattern, -1), 1, F.size(found)), lambda m, b: F.struct(m.alias("m"), b.alias("b")))
        return F.when(F.size(found) == 0, none).otherwise(_once(both, summed))

    there = text.contains(need) if need == "@" else text.rlike(need)
    return F.when(there, _once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)).otherwise(none)


def base_spans(text: Column) -> dict[str, Column]:
    """Valid spans of each kind, from the left."""
    test = lambda k: lambda x: valid(k, x["m"])
    return {k: F.filter(_matches(text, BASE[k], NEEDS[k]), test(k)) for k in KINDS}


def _featured(text: Column, g: int):
    """A span's binned features, and whether the weak rules take it for personal data."""

    def featured(x: Column) -> Column:
        m = x["m"]
        d = _digits(m)
        n = F.length(d)
        left = F.substring(text, F.greatest(F.lit(1), x["s"] - CONTEXT + 1), F.least(F.lit(CONTEXT), x["s"]))
        right = F.substring(text, x["e"] + 1, F.lit(1))
        kind = lambda c: F.when(c == "", 0).when(c.rlike(r"^\s"), 1).when(c.rlike("^[0-9]"), 2).when(c.rlike(r"^\p{L}"), 3).otherwise(4)
        count = lambda c, signs: F.length(F.regexp_replace(c, f"[^{signs}]", ""))
        cue, plus = left.rlike(CUES), m.startswith("+")
        seps, dots = F.lit(0), F.lit(0)
        lead, mix = F.lit(0), F.lit(0)
        if g == 0:
            dots = count(F.substring_index(m, "@", -1), ".")
            mix = F.when(m.rlike(r"\p{L}[^@]*@"), 1).otherwise(0) + F.when(m.rlike(r"\.\p{L}{2,24}\W*$"), 2).otherwise(0)
            accepted = mix == 3
        elif g == 1:
            seps = F.size(F.split(m, "[^0-9]+")) - 1
            dots = count(m, ".")
            lead = F.when(m.rlike("^(?:19|20)[0-9]{2}[-/.]"), 3).when(d.rlike("^[2-6]"), 2).when(d.rlike("^0"), 1).otherwise(0)
            card = n.between(16, 19) & (seps <= 4) & (lead == 2)
            phone = (dots < 3) & (lead != 3) & ((n.between(10, 15) & (seps >= 2)) | (n.between(8, 15) & plus) | (n.between(7, 15) & cue))
            accepted = (card | phone) & ~left.rlike(r"\p{L}$") & ~right.rlike(r"^\p{L}")
        elif g == 2:
            seps = count(m, r"\[\]() ")
            fits = F.forall(F.split(F.regexp_replace(m, "[^0-9.]", ""), r"\."), lambda q: q.cast("int") <= 255)
            mix = F.when(fits, 1).otherwise(0)
            accepted = fits
        else:
            seps = count(m, "_+/=-")
            mix = F.when(m.rlike("[0-9]"), 1).otherwise(0) + F.when(m.rlike("[A-Za-z]"), 2).otherwise(0)
            lead = F.when(left.rlike("[=:] ?[\"']?$"), 2).when(left.rlike("[\"']$"), 1).otherwise(0)
            accepted = (mix == 3) & (n >= 4) & (cue | (lead == 2))
        bins = {
            "gen": F.lit(g),
            "digits": F.least(n, F.lit(20)),
            "plus": plus.cast("int"),
            "seps": F.least(seps, F.lit(4)),
            "paren": m.contains("(").cast("int"),
            "before": kind(F.substring(left, -1, 1)),
            "after": kind(right),
            "cue": cue.cast("int"),
            "dots": F.least(dots, F.lit(3)),
            "lead": lead,
            "mix": mix,
        }
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), *[bins[f].cast("int").alias(f) for f in FEATURES], accepted.cast("int").alias("right"))

    return featured


def candidates(text: Column) -> Column:
    """Spans of all generators with their features."""
    own = []
    for g, (name, pattern) in enumerate(WIDE.items()):
        spans = _matches(text, pattern, WIDE_NEEDS[name])
        if name == "number":
            spans = F.filter(spans, lambda x: F.length(_digits(x["m"])).between(7, 19))
        own.append(F.transform(spans, _featured(text, g)))
    return F.concat(*own)


@dataclass(frozen=True)
class Model:
    #: Trees as nested tuples (feature, at most, left, right) with numbers as leaves.
    trees: tuple = ()
    bias: float = 0.0
    #: Score from which a generator's candidates are taken; those without one take none.
    thresholds: dict[int, float] = field(default_factory=dict)


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """A regression tree on cells: features (a column each), gradient sums, hessian sums."""
    all_g, all_h = g.sum(), h.sum()
    best, gain = None, 1e-6
    for f in range(len(FEATURES) if depth else 0):
        gl, hl = np.cumsum(np.bincount(x[:, f], weights=g))[:-1], np.cumsum(np.bincount(x[:, f], weights=h))[:-1]
        better = np.where(np.minimum(hl, all_h - hl) < 0.5, 0, gl**2 / (hl + 1) + (all_g - gl) ** 2 / (all_h - hl + 1) - all_g**2 / (all_h + 1))
        if len(better) and better.max() > gain:
            best, gain = (f, int(better.argmax())), better.max()
    if best is None:
        return float(-RATE * all_g / (all_h + 1))
    left = x[:, best[0]] <= best[1]
    return FEATURES[best[0]], best[1], grow(x[left], g[left], h[left], depth - 1), grow(x[~left], g[~left], h[~left], depth - 1)


def value(tree, x: dict[str, int]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def boost(cells: list[tuple[dict[str, int], int, int]]) -> tuple[tuple, float]:
    """Trees and bias from cells (features, number, number that are right)."""
    n, right = sum(c[1] for c in cells), sum(c[2] for c in cells)
    if not n:
        return (), 0.0
    p = min(max(right / n, 1e-3), 1 - 1e-3)
    bias, trees = math.log(p / (1 - p)), []
    x = np.array([[c[0][f] for f in FEATURES] for c in cells])
    count, ok = np.array([c[1] for c in cells], dtype=float), np.array([c[2] for c in cells], dtype=float)
    score = np.full(len(cells), bias)
    for _ in range(TREES):
        q = 1 / (1 + np.exp(-score))
        tree = grow(x, count * q - ok, count * q * (1 - q), DEPTH)
        trees.append(tree)
        score += [value(tree, c[0]) for c in cells]
    return tuple(trees), bias


def calibrated(trees: tuple, bias: float, cells: list[tuple[dict[str, int], int, int]], precision: float) -> dict[int, float]:
    """For each generator the lowest score above which held-back candidates are right often enough."""
    found = {}
    for g in {c[0]["gen"] for c in cells}:
        scored = sorted(((bias + sum(value(t, x) for t in trees), n, ok) for x, n, ok in cells if x["gen"] == g), reverse=True, key=lambda r: r[0])
        n = right = 0
        for k, (s, count, ok) in enumerate(scored):
            n, right = n + count, right + ok
            if k + 1 < len(scored) and scored[k + 1][0] == s:
                continue
            if right >= precision * n:
                found[g] = s - 1e-9
    return found


def fit(docs: DataFrame, *, precision: float = PRECISION) -> Model:
    """Count cells over all documents; two thirds of the documents train, the rest sets thresholds."""
    chosen = docs.select((F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0).alias("held"), F.explode(candidates(F.coalesce(F.col("text"), F.lit("")))).alias("c"))
    # No more rows than there are combinations of bins, however many documents.
    rows = chosen.groupBy("held", *[F.col(f"c.{f}").alias(f) for f in FEATURES]).agg(F.count("*").alias("n"), F.sum("c.right").alias("ok")).collect()
    rows.sort(key=lambda r: tuple(r))
    cells = {h: [({f: r[f] for f in FEATURES}, r["n"], r["ok"]) for r in rows if r["held"] == h] for h in (False, True)}
    trees, bias = boost(cells[False])
    return Model(trees, bias, calibrated(trees, bias, cells[True], precision))


def score(model: Model, c: Column) -> Column:
    """The trees as one expression over a candidate's features."""

    def sql(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        return F.when(c[tree[0]] <= tree[1], sql(tree[2])).otherwise(sql(tree[3]))

    total = F.lit(model.bias)
    for t in model.trees:
        total = total + sql(t)
    return total


def find(docs: DataFrame, model: Model, base: str, every: str) -> DataFrame:
    """docs with two more columns: base spans and all spans, as arrays of (kind number, s, e), by kind, then start."""
    text = F.coalesce(F.col("text"), F.lit(""))
    pair = lambda k: lambda x: F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e"))
    spans = base_spans(text)
    out = docs.withColumn(base, F.concat(*[F.transform(spans[k], pair(i)) for i, k in enumerate(KINDS)]))
    none = F.expr("cast(array() as array<struct<k:int,s:int,e:int>>)")
    if not model.thresholds:
        return out.withColumn(every, F.col(base))
    (wide,) = fresh(out, "wide")
    out = out.withColumn(wide, candidates(text))

    def taken(c: Column) -> Column:
        enough = F.lit(False)
        for g, t in model.thresholds.items():
            enough = enough | ((c["gen"] == g) & (score(model, c) >= t))
        return enough & ~F.exists(base, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))

    kind = lambda c: F.when(c["gen"] == 0, 0).when(c["gen"] == 2, 1).when(c["gen"] == 3, 4).when(c["digits"] < 16, 3).otherwise(2)
    added = F.transform(F.filter(wide, taken), lambda c: F.struct(kind(c).alias("k"), c["s"].alias("s"), c["e"].alias("e")))
    return out.withColumn(every, F.array_sort(F.array_distinct(F.concat(base, F.coalesce(added, none))))).drop(wide)


def joined(spans: str) -> Column:
    name = lambda x: F.element_at(F.array(*map(F.lit, NAMES)), x["k"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["s"], x["e"])), ",")


def report(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per document: doc_id, numbers of base spans, their digest, and all spans."""
    docs = docs.select("doc_id", "text")
    found = find(docs, model or fit(docs), "base", "every")
    count = lambda i: F.size(F.filter("base", lambda x: x["k"] == i)).cast("long")
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("every").alias("spans"))


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs with spans replaced by their kind in angle brackets, and n_chars (if there) brought up to date.

    Overlapping spans become one, named by the first, or the longest of those that begin there. Texts without spans stay as they are, null included.
    """
    base, every = fresh(docs, "base", "every")
    found = find(docs, model or fit(docs), base, every)
    by_start = F.array_sort(F.transform(every, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), x["k"].alias("k"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        clear = F.substring(F.col("text"), acc["at"] + 1, F.greatest(F.lit(0), x["s"] - acc["at"]))
        tag = F.when(x["s"] >= acc["at"], F.concat(clear, F.lit("<"), F.element_at(F.array(*map(F.lit, NAMES)), x["k"] + 1), F.lit(">"))).otherwise("")
        return F.struct(F.greatest(acc["at"], -x["e"]).alias("at"), F.concat(acc["out"], tag).alias("out"))

    clean = F.aggregate(by_start, start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.lit(2**31 - 1))))
    text = F.when(F.size(every) > 0, clean).otherwise(F.col("text"))
    out = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.drop(base, every)
