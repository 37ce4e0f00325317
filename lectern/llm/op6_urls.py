"""Operator 6: URL filter by rules and gradient-boosted trees on lexical features, DataFrame functions only.

Features are SQL expressions over the URL: lengths, depth, digit ratio, character entropy, parameter counts,
hyphens, and the block rate of the host's suffix in the training sample.  The trees are fitted on the driver from a
bounded sample of labelled URLs (``SAMPLE_URLS`` distinct ones in expectation, never over twice that) and become one
CASE expression, so scoring is a projection without shuffle or Python.

The query's labels come from a fixed word list over host names (``BLOCK_WORDS``); the features never see the words.

Cases: a URL that is null or lacks ``://`` has empty host and path; it is still judged by the trees.  Rows are kept
one for one; an empty table gives no row; without labelled URLs of both kinds the trees' score is the share of
blocked ones (0 without any).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_URLS = 20_000
TREES, DEPTH, RATE, BINS, LEAF_MIN = 24, 3, 0.3, 32, 20
SUFFIXES = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words in a host name that label it as blocked.
BLOCK_WORDS = ("adult", "casino", "pills", "spam", "xxx", "porn", "poker", "viagra", "malware", "phish")
NUMERIC = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digits", "hyphens", "params", "query_length", "entropy", "upper_ratio", "fragment", "suffix_rate")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #``, A-Z lower-cased; path: from there up to ``? #``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def match_rules(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """``(rule, verdict)`` of the longest fitting rule ``(verdict, host, path prefix)``, null where none fits."""
    rule = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def count_of(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("double")


def features(df: DataFrame) -> DataFrame:
    """Adds the numeric features but for ``suffix_rate``, and ``suffix``, to rows with url, host and path."""
    url = F.coalesce("url", F.lit(""))
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    chars = F.array_distinct(F.split(url, ""))

    def part(c: Column) -> Column:
        share = (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n
        return F.when(share > 0, -share * F.log2(share)).otherwise(F.lit(0.0))

    return df.withColumns(
        {
            "length": F.length(url).cast("double"),
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "depth": (F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))).cast("double"),
            "labels": (F.length("host") - F.length(F.replace("host", F.lit("."), F.lit("")))).cast("double"),
            "digit_ratio": count_of(url, "[0-9]") / n,
            "host_digits": count_of(F.col("host"), "[0-9]"),
            "hyphens": count_of(F.col("host"), "-"),
            "params": F.when(F.length(query) > 0, count_of(query, "&") + 1).otherwise(F.lit(0.0)),
            "query_length": F.length(query).cast("double"),
            "entropy": F.aggregate(F.filter(chars, lambda c: F.length(c) > 0), F.lit(0.0), lambda acc, c: acc + part(c)),
            "upper_ratio": count_of(url, "[A-Z]") / n,
            "fragment": F.when(F.instr(url, "#") > 0, 1.0).otherwise(0.0),
            "suffix": F.element_at(F.split("host", r"\."), -1),
        }
    )


@dataclass
class Tree:
    """A split ``feature < at`` with branches, or a leaf value."""

    value: float = 0.0
    feature: str = ""
    at: float = 0.0
    low: Tree | None = None
    high: Tree | None = None

    def sql(self) -> str:
        if self.low is None or self.high is None:
            return f"{self.value:.12g}D"
        return f"CASE WHEN {self.feature} < {self.at:.17g}D THEN {self.low.sql()} ELSE {self.high.sql()} END"


def grow(x: np.ndarray, bins: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int) -> Tree:
    def score(gs, hs):
        return gs * gs / (hs + 1.0)

    total_g, total_h = g[rows].sum(), h[rows].sum()
    best = (1e-6, -1, 0)
    if depth and len(rows) >= 2 * LEAF_MIN:
        for f in range(x.shape[1]):
            size = len(edges[f]) + 1
            b = bins[rows, f]
            gs = np.cumsum(np.bincount(b, g[rows], size))[:-1]
            hs = np.cumsum(np.bincount(b, h[rows], size))[:-1]
            ns = np.cumsum(np.bincount(b, minlength=size))[:-1]
            gain = np.where((ns >= LEAF_MIN) & (len(rows) - ns >= LEAF_MIN), score(gs, hs) + score(total_g - gs, total_h - hs) - score(total_g, total_h), -1)
            if len(gain) and gain.max() > best[0]:
                best = (float(gain.max()), f, int(gain.argmax()))
    if best[1] < 0:
        return Tree(value=float(-RATE * total_g / (total_h + 1.0)))
    _, f, k = best
    low = bins[rows, f] <= k
    return Tree(feature=NUMERIC[f], at=float(edges[f][k]), low=grow(x, bins, edges, g, h, rows[low], depth - 1), high=grow(x, bins, edges, g, h, rows[~low], depth - 1))


def boost(x: np.ndarray, y: np.ndarray) -> tuple[float, list[Tree]]:
    """Logistic boosting with histogram splits: the starting log-odds and the trees."""
    if not len(y) or y.min() == y.max():
        return (60.0 if len(y) and y.max() else -60.0), []
    share = y.mean()
    base = math.log(share / (1 - share))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="higher")) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)], axis=1)
    out, total = [], np.full(len(y), base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        tree = grow(x, bins, edges, p - y, p * (1 - p), np.arange(len(y)), DEPTH)
        out.append(tree)
        total = total + predict(tree, x)
    return base, out


def predict(tree: Tree, x: np.ndarray) -> np.ndarray:
    if tree.low is None or tree.high is None:
        return np.full(len(x), tree.value)
    return np.where(x[:, NUMERIC.index(tree.feature)] < tree.at, predict(tree.low, x), predict(tree.high, x))


@dataclass
class Model:
    base: float
    trees: list[Tree]
    rates: dict[str, float]
    prior: float

    def suffix_rate(self) -> Column:
        if not self.rates:
            return F.lit(self.prior)
        pairs = [F.lit(v) for kv in sorted(self.rates.items()) for v in kv]
        return F.coalesce(F.create_map(*pairs)[F.col("suffix")], F.lit(self.prior))

    def score(self) -> Column:
        margin = F.expr(" + ".join([f"{self.base:.12g}D", *(f"({t.sql()})" for t in self.trees)]))
        return 1 / (1 + F.exp(-margin))


def word_labels(host: Column) -> Column:
    """1 where the host holds a blocked word, 0 where not, null for an empty host."""
    return F.when(host == "", F.lit(None)).when(host.rlike("|".join(BLOCK_WORDS)), 1).otherwise(0)


def fit(labelled: DataFrame) -> Model:
    """Trees from rows ``(url, host, path, label)``; label 0, 1 or null (not used)."""
    known = labelled.where(F.col("label").isNotNull())
    n = known.count()
    slots = 1 << 30
    keep = min(slots, math.ceil(slots * SAMPLE_URLS / max(n, 1)))
    sample = features(known.where(F.pmod(F.xxhash64("url"), F.lit(slots)) < keep).select("url", "host", "path", "label").distinct().limit(2 * SAMPLE_URLS))
    rows = sample.select(*[c for c in NUMERIC if c != "suffix_rate"], "suffix", F.col("label").cast("double")).collect()
    y = np.array([r["label"] for r in rows])
    prior = float(y.mean()) if len(y) else 0.0
    seen: dict[str, list[float]] = {}
    for r in rows:
        seen.setdefault(r["suffix"], []).append(r["label"])
    common = sorted(seen, key=lambda s: (-len(seen[s]), s))[:SUFFIXES]
    rates = {s: (sum(seen[s]) + 10 * prior) / (len(seen[s]) + 10) for s in common}
    x = np.array([[rates.get(r["suffix"], prior) if c == "suffix_rate" else r[c] for c in NUMERIC] for r in rows], "f8").reshape(len(rows), len(NUMERIC))
    order = np.lexsort((y, *x.T)) if len(y) else np.arange(0)  # the fit doesn't depend on the order of collected rows
    base, trees = boost(x[order], y[order])
    return Model(base, trees, rates, prior)


def judge(df: DataFrame, rules: list[tuple[str, str, str]], key: str = "page_id", url: str = "url", labels=word_labels, threshold: float = 0.5) -> DataFrame:
    """Rows ``(key, host, path, rule, verdict, score)``: the longest rule's verdict, else block where the trees' score reaches the threshold."""
    host, path = host_path(F.col("url"))
    rows = df.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url")).withColumns({"host": host, "path": path})
    model = fit(rows.withColumn("label", labels(F.col("host"))))
    rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
    scored = features(rows).withColumn("suffix_rate", model.suffix_rate()).withColumn("score", model.score())
    judged = F.coalesce(verdict, F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return scored.select(F.col("key").alias(key), "host", "path", rule.alias("rule"), judged.alias("verdict"), "score")
