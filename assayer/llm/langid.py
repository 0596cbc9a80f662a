"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its hashed byte n-grams (2 to 4 bytes, A-Z in lower case). Embeddings and the
softmax layer are trained together by stochastic gradient descent in numpy, on at most `per_language` labelled texts of
each language, the first by a hash of their content. A temperature that fits held-back texts calibrates the probability;
predictions below the level that REJECT_RATE of the held-back texts fall short of are marked as rejected.

For prediction, embedding and softmax are one table of bucket by language, which is broadcast: its size is fixed by
BUCKETS and the number of languages.

Null text, and text without a letter, is "und" with score 0 and rejected. Without any labelled text every prediction is
"und". Ties go to the language that comes first in order. Repeated rows are predicted alike; columns other than those named
aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm import textarrays

BUCKETS, DIMENSIONS, SIZES = 1 << 16, 16, (2, 3, 4)
#: Bound of the training sample: whole texts of one language.
PER_LANGUAGE = 600
EPOCHS, BATCH, RATE, HELD_BACK, REJECT_RATE = 10, 32, 4.0, 0.2, 0.005
UNDETERMINED = "und"

_U = np.uint64
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], _U)


def buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of each n-gram within one text."""
    flat = textarrays.Bytes.of(texts)
    data = _LOWER[flat.data]
    owner = np.repeat(np.arange(len(texts)), np.diff(flat.starts))
    all_text, all_bucket = [], []
    for size in SIZES:
        n = len(data) - size + 1
        if n <= 0:
            continue
        gram = np.full(n, size, _U)
        for j in range(size):
            gram = (gram << _U(8)) | data[j : j + n]
        whole = owner[:n] == owner[size - 1 :]
        all_text.append(owner[:n][whole])
        all_bucket.append(((gram[whole] * _U(0x9E3779B97F4A7C15)) >> _U(48)).astype(np.int64) % BUCKETS)
    if not all_text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(all_text), np.concatenate(all_bucket)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # bucket x language: what an n-gram adds to the logits
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, texts: list[str]) -> np.ndarray:
        text, bucket = buckets(texts)
        n = np.maximum(np.bincount(text, minlength=len(texts)), 1)
        sums = np.stack([np.bincount(text, self.table[bucket, k], len(texts)) for k in range(len(self.languages))], axis=1)
        return sums / n[:, None] + self.bias

    def probabilities(self, texts: list[str]) -> np.ndarray:
        return softmax(self.logits(texts) / self.temperature)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: list[str], seed: int = 1) -> Model:
    """Fit on most of the texts; temperature and rejection level on the rest."""
    languages = sorted(set(labels))
    y = np.searchsorted(languages, labels)
    random = np.random.default_rng(seed)
    order = random.permutation(len(texts))
    held, fit = order[: int(HELD_BACK * len(order))], order[int(HELD_BACK * len(order)) :]
    features = [np.unique(buckets([t])[1], return_counts=True) for t in texts]
    embed = random.normal(0, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    weight, bias = np.zeros((DIMENSIONS, len(languages))), np.zeros(len(languages))
    weight += random.normal(0, 0.1, weight.shape)
    steps = max(1, EPOCHS * -(-len(fit) // BATCH))
    step = 0
    for _ in range(EPOCHS):
        for i in range(0, len(fit), BATCH):
            rows = random.permutation(fit)[:BATCH] if len(fit) <= BATCH else fit[i : i + BATCH]
            rate = RATE * (1 - step / steps)
            mean = np.stack([(c / max(1, c.sum())) @ embed[b] for b, c in (features[r] for r in rows)])
            error = softmax(mean @ weight + bias)
            error[np.arange(len(rows)), y[rows]] -= 1
            error /= len(rows)
            back = error @ weight.T
            weight -= rate * mean.T @ error
            bias -= rate * error.sum(axis=0)
            for r, g in zip(rows, back, strict=True):
                b, c = features[r]
                embed[b] -= rate * BUCKETS**0.25 * (c / max(1, c.sum()))[:, None] * g
            step += 1
        random.shuffle(fit)
    model = Model(languages, (embed @ weight).astype(np.float32), bias)
    return calibrate(model, [texts[i] for i in held], y[held]) if len(held) else model


def calibrate(model: Model, texts: list[str], y: np.ndarray) -> Model:
    """The temperature of the smallest log loss, and the level below which predictions are rejected."""
    logits = model.logits(texts)
    grid = np.geomspace(0.02, 10, 60)
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    model.reject_below = float(np.quantile(model.probabilities(texts).max(axis=1), REJECT_RATE))
    return model


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model | None:
    """Train on a bounded sample of labelled rows, each text once; their number is at most per_language x languages."""
    labelled = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    ranked = labelled.select("lang", "text", F.xxhash64("text").alias("draw"))
    total = ranked.groupBy("lang").count().collect()  # one row for each language
    share = F.create_map(*[x for r in total for x in (F.lit(r.lang), F.lit(min(1.0, 3 * per_language / r["count"])))]) if total else None
    if share is None:
        return None
    near = ranked.filter(F.pmod("draw", F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)  # about three times the sample
    once = near.groupBy("lang", "draw").agg(F.first("text").alias("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    rows = once.withColumn("nth", nth).filter(F.col("nth") <= per_language).collect()
    rows.sort(key=lambda r: (r.lang, r.draw))
    return train([r.text for r in rows], [r.lang for r in rows]) if rows else None


def predict(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns in `keep`, lang_pred, score and rejected, from whole texts."""
    known = model or Model([UNDETERMINED], np.zeros((BUCKETS, 1), np.float32), np.zeros(1))
    shared = docs.sparkSession.sparkContext.broadcast(known)
    n = len(keep)
    named = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("_letters"), F.col(text_col).alias("_text"))

    def work(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        m: Model = shared.value
        p = m.probabilities(texts)
        best, letters = p.argmax(axis=1), np.array(batch.column(n).to_pylist(), bool)
        score = np.where(letters & (m.languages != [UNDETERMINED]), p.max(axis=1), 0.0)
        lang = [m.languages[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
        columns = [pa.array(lang), pa.array(score, pa.float64()), pa.array(~letters | (score < m.reject_below))]
        return pa.RecordBatch.from_arrays([*batch.columns[:n], *columns], [*names, "lang_pred", "score", "rejected"])

    fields = named.schema.fields[:n]
    names = [f.name for f in fields]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields) + "lang_pred string, score double, rejected boolean"
    out = textarrays.map_texts(named, work, "_text", schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score", "rejected")
