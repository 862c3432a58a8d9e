"""Language identification with averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its byte 3- and 4-grams, hashed to a table; a linear layer and a
softmax give the language. Both layers are trained by stochastic gradient descent in numpy on a bounded sample
of labelled rows. As averaging and the linear layer are linear, a trained model is one table of a row of
scores per bucket, and a prediction is the mean of the rows of a whole text's grams. A temperature and the
score below which a prediction is rejected are calibrated on part of the sample that training does not see.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text, materialize

BUCKETS = 1 << 14
SAMPLE_PER_LANG = 400  # labelled rows per language for training: those with the smallest hashes of their text
PARTS = 256  # that a language's hashes meet its share in
LETTER = re.compile(r"[^\W\d_]")
SPACED = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def grams(text: bytes) -> np.ndarray:
    """Buckets of the 3- and 4-grams of a lower-cased text, with all but letters as single blanks."""
    b = np.frombuffer(b" " + b" ".join(text.translate(SPACED).split()) + b" ", np.uint8).astype(np.uint32)
    three = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    four = (three[:-1] << np.uint32(8)) | b[3:]
    mult = np.uint32(2654435761)
    return np.concatenate([(three * mult) >> np.uint32(18), ((four ^ np.uint32(0x5BD1E995)) * mult) >> np.uint32(18)])


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # BUCKETS x languages
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, g: np.ndarray) -> np.ndarray:
        total = np.zeros(len(self.langs))
        for i in range(0, len(g), 1 << 18):
            total += self.table[g[i : i + (1 << 18)]].sum(axis=0, dtype=np.float64)
        return total / max(len(g), 1) + self.bias

    def probabilities(self, g: np.ndarray) -> np.ndarray:
        z = self.logits(g) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def counted(text: bytes) -> np.ndarray:
    """Buckets of a whole lower-cased text with the number of its grams in each, as two rows."""
    return np.stack(np.unique(grams(text), return_counts=True)).astype(np.int64)


def train(rows: list[tuple[str, np.ndarray]], dim: int = 16, epochs: int = 6, rate: float = 2.0, seed: int = 3) -> Model | None:
    """SGD on (lang, buckets and counts of a text) rows; None without rows. Every fifth row calibrates."""
    if not rows:
        return None
    langs = sorted({x for x, _ in rows})
    rng = np.random.default_rng(seed)
    data = [(langs.index(x), u, (n / n.sum()).astype(np.float32)) for x, (u, n) in rows if len(u)]
    order = rng.permutation(len(data))
    held, fit = order[: len(data) // 5], order[len(data) // 5 :]
    e = rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32)
    w, bias = np.zeros((dim, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    for epoch in range(epochs):
        lr = rate * (1 - epoch / epochs)
        for i in rng.permutation(fit).tolist():
            y, u, n = data[i]
            h = n @ e[u]
            z = h @ w + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = w @ p
            w -= lr * np.outer(h, p)
            bias -= lr * 0.1 * p
            e[u] -= (lr * 20) * n[:, None] * back
    model = Model(langs, (e @ w).astype(np.float32), bias.astype(np.float64))
    check = held if len(held) >= 20 else fit
    z = np.stack([(model.table[data[i][1]] * data[i][2][:, None]).sum(axis=0) + model.bias for i in check.tolist()]) if len(check) else np.zeros((1, len(langs)))
    y = np.array([data[i][0] for i in check.tolist()]) if len(check) else np.zeros(1, int)

    def soft(t: float) -> np.ndarray:
        x = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return x / x.sum(axis=1, keepdims=True)

    temperatures = np.geomspace(0.5, 20, 40)
    model.temperature = float(min(temperatures, key=lambda t: -np.log(soft(t)[np.arange(len(y)), y] + 1e-12).mean()))
    p = soft(model.temperature)
    top, right = p.max(axis=1), p.argmax(axis=1) == y
    # the least score from which on at least 99 % are right
    best = np.argsort(-top)
    good = np.cumsum(right[best]) / np.arange(1, len(best) + 1) >= 0.99
    model.reject_below = float(top[best][np.flatnonzero(good)[-1]]) if good.any() else 1.0
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> list[tuple[str, np.ndarray]]:
    """The bounded training sample: of each language the rows with the smallest text hashes, not held out.

    Rows are chosen by hash alone; only the texts of the chosen ones, a bounded number, are read after that. Texts are
    counted by language first, and only hashes so small that about 4 * `per_lang` are smaller are ranked: no task gets all
    rows of a language. Texts of any length take part, whole: tasks turn them into counts by bucket, and only these, at
    most one for each bucket, come to the driver.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.withColumn("h", F.xxhash64("text"))
    hashes = materialize(rows.select("lang", "h").distinct(), "lang-hashes").withColumn("part", F.pmod("h", F.lit(PARTS)))
    share = F.least(F.lit(1.0), F.lit(4.0 * per_lang) / F.count("*"))
    low = hashes.groupBy("lang").agg(share.alias("share")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    first = Window.partitionBy("lang").orderBy("h")
    chosen = hashes.join(low, ["lang", "part"]).filter(F.col("h") / float(1 << 64) + 0.5 <= F.col("share"))
    chosen = chosen.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= per_lang)
    chosen = materialize(chosen.select("lang", "h"), "lang-sample")
    texts = rows.join(chosen, ["lang", "h"]).select("lang", "h", F.lower("text").alias("text"))
    # blank texts teach nothing; of rows with one hash the counts of one stand for all, as their texts are equal
    made = map_text(texts, "text", [("counts", T.BinaryType())], lambda ts: [[counted(t).tobytes() if t.strip() else b"" for t in ts]], ("lang", "h"))
    found = made.groupBy("lang", "h").agg(F.min("counts").alias("counts")).collect()
    found.sort(key=lambda r: (r["lang"], r["h"]))
    return [(r["lang"], np.frombuffer(r["counts"], np.int64).reshape(2, -1)) for r in found]


def predict(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, lang_pred, score (calibrated probability) and accepted, for the whole text of each row.

    und with score 0 where the text is null or has no letter, or nothing was learned. Others always get a learned
    language, of equal scores the first by name; accepted tells whether the score reaches the calibrated
    threshold. Very long texts are summed in pieces; repeated rows get the same result; an empty table gives no
    rows. Columns other than `keep` and text are not looked at, so they may have any name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[bytes | None]) -> list:
        m, langs, scores, ok = shared.value, [], [], []
        for t in texts:
            if m is None or not t or not (LETTER.search(t[:4096].decode(errors="ignore")) or LETTER.search(t.decode(errors="ignore"))):
                langs.append("und")
                scores.append(0.0)
                ok.append(False)
                continue
            p = m.probabilities(grams(t))
            langs.append(m.langs[int(p.argmax())])
            scores.append(float(p.max()))
            ok.append(bool(p.max() >= m.reject_below))
        return [langs, scores, ok]

    lowered = docs.select(*keep, F.lower("text").alias("__lower"))
    return map_text(lowered, "__lower", [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("accepted", T.BooleanType())], run, keep)


def op4_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learned from those not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = predict(docs, train(sample(docs)))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")
