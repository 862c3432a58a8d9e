"""Quality classifier with hierarchical empirical Bayes.

A logistic model on cheap text statistics gives each document its evidence. Sites are judged by their
documents: with beta-binomial shrinkage (prior strengths from the spread between groups, by moments) a host's
mean is drawn to the global mean and a path's mean to its host's, the more the fewer documents it has. A
document's posterior log odds are its evidence plus what its path's posterior adds to the global prior.

Groups are sums over documents, combined before the shuffle, so a host with a third of all rows is a few
partial sums. Scoring reads the texts a second time instead of shuffling them; the table of path posteriors
meets the documents in a join that Spark broadcasts while that table's files are small and shuffles beyond.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text, materialize, packed

MAX_LABELLED = 20_000  # labelled documents that the model is fitted on: those with the smallest hashes of their ids
N_FEATURES = 16
CLASSES = np.zeros((256, 7), np.float64)  # lower, upper, digit, blank, sentence marks, other ASCII marks, beyond ASCII
for _c in range(256):
    _s = chr(_c)
    CLASSES[_c, 6 if _c >= 128 else 0 if _s.islower() else 1 if _s.isupper() else 2 if _s.isdigit() else 3 if _s.isspace() else 4 if _s in ".,;:'\"?-()" else 5] = 1


def features(text: bytes | None) -> np.ndarray:
    """Statistics of one text; zeros for a null or wordless one."""
    text = text or b""
    words = text.split()
    if not words:
        return np.zeros(N_FEATURES)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = counts @ CLASSES / len(text)
    n, distinct = len(words), len(set(words))
    lines = text.split(b"\n")
    packed = len(zlib.compress(text, 1)) / len(text)
    return np.array([1, *share, counts[124] / n, counts[33] / n, np.log1p(n), distinct / n, len(set(lines)) / len(lines), (len(text) - counts[32]) / n / 10, packed, np.log1p(len(lines) / n * 100)])


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights) of a ridge logistic regression by Newton's method; no labels or one class: the prior only."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    mean[0], scale[0] = 0, 1
    z, w = (x - mean) / scale, np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The model from at most `max_labelled` labelled documents; only their features come to the driver.

    Those with the smallest hashes of id and text; a doc_id with several labels counts as good if any is, rows that
    repeat id and text are one document.
    """
    marks = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    named = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    chosen = named.select("doc_id", "th").join(marks, "doc_id").distinct().orderBy(F.xxhash64("doc_id", "th"), "doc_id", "th").limit(max_labelled)
    rows = named.join(materialize(chosen, "quality-labels"), ["doc_id", "th"]).dropDuplicates(["doc_id", "th"])
    rows = map_text(rows, "text", [("x", T.ArrayType(T.DoubleType()))], lambda texts: [[features(t) for t in texts]], ("doc_id", "th", "quality")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["th"]))
    if not rows:
        return np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES)
    return fit(np.array([r["x"] for r in rows]), np.array([float(r["quality"] > 0) for r in rows]))


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray], keep: list[str], text: str = "text") -> DataFrame:
    """`keep` and __p: the classifier's probability of good; null for texts without words."""
    mean, scale, w = model

    def run(texts: list[bytes | None]) -> list:
        x = np.array([features(t) for t in texts]).reshape(-1, N_FEATURES)
        p = 1 / (1 + np.exp(-np.clip((x - mean) / scale @ w, -30, 30)))
        return [[v if ok else None for v, ok in zip(p.tolist(), (x[:, 0] > 0).tolist(), strict=True)]]

    return map_text(docs, text, [("__p", T.DoubleType())], run, keep)


def strength(groups: DataFrame, mean: str, n: str, prior: Column, spread: float) -> float:
    """Documents that the prior counts for: within-group variance over what the groups' means vary beyond chance."""
    row = groups.agg(F.sum(n).alias("n"), F.sum(F.col(n) * F.pow(F.col(mean) - prior, 2)).alias("ss"), F.count("*").alias("k"), F.sum(F.col(n) * F.col(n)).alias("nn")).first()
    if not row["n"] or row["n"] * row["n"] <= row["nn"]:
        return 10.0
    between = (row["ss"] - row["k"] * spread) / (row["n"] - row["nn"] / row["n"])
    return float(np.clip(spread / between if between > 0 else 1e4, 1.0, 1e4))


def site_posteriors(scores: DataFrame) -> tuple[DataFrame, float]:
    """(host, path, path_mean) shrunken, and the global mean, from scores (host, path, __p)."""
    paths = materialize(scores.filter("__p IS NOT NULL").groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("__p").alias("s"), F.sum(F.pow("__p", F.lit(2))).alias("ss")), "quality-paths")
    whole = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).first()
    if not whole["n"]:
        return paths.select("host", "path", F.lit(0.5).alias("path_mean")), 0.5
    mean = whole["s"] / whole["n"]
    spread = max(whole["ss"] / whole["n"] - mean**2, 1e-6)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    k = strength(hosts.withColumn("m", F.col("hs") / F.col("hn")), "m", "hn", F.lit(mean), spread)
    hosts = hosts.select(F.col("host").alias("h"), ((k * mean + F.col("hs")) / (k + F.col("hn"))).alias("host_mean"))
    both = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).withColumn("m", F.col("s") / F.col("n"))
    k = strength(both, "m", "n", F.col("host_mean"), spread)
    return materialize(both.select("host", "path", ((k * F.col("host_mean") + F.col("s")) / (k + F.col("n"))).alias("path_mean")), "quality-sites"), mean


def log_odds(p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(q / (1 - q))


def _judged(docs: DataFrame, labels: DataFrame, host: Column | None, path: Column | None, least: float) -> DataFrame:
    """row (all columns of `docs`), p, site, quality, keep."""
    host = F.col("source") if host is None else host
    path = F.to_json(F.struct("source", "lang")) if path is None else path  # leaves nulls out, so they differ from empty strings
    model = train(docs, labels)
    keyed = packed(docs, host.cast("string").alias("host"), path.cast("string").alias("path"), F.col("text").alias("text"))
    sites, mean = site_posteriors(scored(keyed, model, ["host", "path"]))
    sites = sites.select(F.col("host").alias("h"), F.col("path").alias("q"), "path_mean")
    done = scored(keyed, model, ["row", "host", "path"])
    done = done.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")), "left")
    site = F.coalesce("path_mean", F.lit(mean))
    odds = log_odds(F.col("__p")) + log_odds(site) - log_odds(F.lit(mean))
    done = done.select("row", F.col("__p").alias("p"), site.alias("site"), F.when(F.col("__p").isNotNull(), 1 / (1 + F.exp(-odds))).alias("quality"))
    return done.withColumn("keep", F.coalesce(F.col("quality") >= least, F.lit(False)))


def judge(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, least: float = 0.5) -> DataFrame:
    """`docs` with __p (classifier), __site (shrunken mean of its path), __quality (posterior) and __keep.

    `host` and `path` are columns of `docs`, by default source, and source and lang. Null hosts and paths are
    groups of their own, apart from empty ones. Texts without words have no evidence and are not kept (__p and
    __quality null); whole texts are read, however long. Rows are judged one by one, repeated or not; without
    labels the evidence is even. Other columns stay, whatever their names; those named like a result give way to
    it. An empty table gives no rows.
    """
    done = _judged(docs, labels, host, path, least)
    made = {"__p": "p", "__site": "site", "__quality": "quality", "__keep": "keep"}
    return done.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in made], *[F.col(old).alias(new) for new, old in made.items()])


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier keeps, with their own columns.

    Those whose posterior is at least even: a null or wordless text goes, an empty table gives none, repeated rows stay
    or go alike, whole texts count and extra columns stay.
    """
    return _judged(docs, labels, None, None, 0.5).filter("keep").select("row.*")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence, site mean, posterior and verdict of every document."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    done = judge(docs, labels)
    return done.select("doc_id", F.col("__p").alias("evidence"), F.col("__site").alias("site_mean"), F.col("__quality").alias("quality"), F.col("__keep").alias("keep"))
