"""Quality scores by positive-unlabelled learning.

Trusted positives (rows labelled 1) and unlabelled text train a small network by minimising the non-negative
unbiased risk: ``pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))`` with the logistic loss, where a mini-batch whose
second term is negative takes a step that undoes the overfit. Labels of 0 are not used. The class prior ``pi``
is estimated: a first network separates positives from unlabelled rows, and on rows that it hasn't seen the
prior is the least ratio of the unlabelled to the positive rows above a threshold (with a margin for chance),
since the unlabelled rows above any threshold hold at least the prior's share of positives.

Inputs of a score are only measures of the whole text: shares of kinds of bytes and of pairs of kinds, length,
word lengths, and how often words and runs of three words repeat. Training takes a bounded sample, ``MOST`` rows
of each kind picked by a hash of the text; every document is scored.

Defined cases: a null text is an empty one, and both get the score that the network gives to a text without
bytes; repeated rows get equal scores; labels for unknown documents and null labels teach nothing; without
positives every score is 0.5. Several labels of one document count as positive if one of them is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxtone.llm.common import held_out, small_batches
from fluxtone.llm.textops import joined, mix, parts, words

#: Bound of the sample: so many positives and so many unlabelled rows.
MOST = 6000
HIDDEN, EPOCHS, BATCH, RATE, SEED = 24, 60, 512, 0.01, 5
#: A score from here on predicts label 1.
THRESHOLD = 0.7

_KINDS = 16
_KIND = np.full(256, 1, np.uint8)  # other ASCII
for _k, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), b" ", b"\n", b"\t\r\x0b\x0c", b".,;:", b"!?", b"|", b"*&%$#", b"'\"-()", b"@/\\+=_", range(128, 192), range(192, 256)), 2):
    _KIND[list(_bytes)] = _k


def features(texts: list[bytes | None]) -> np.ndarray:
    """One or more texts x measures."""
    data, starts = joined(texts)
    data += b"\n"
    n, size = len(texts), np.array([len(t or b"") for t in texts], np.float64)
    kind = np.zeros(len(data) + 1, np.int64)
    kind[1:] = _KIND[np.frombuffer(data, np.uint8)]
    kind[starts[1:]] = 0  # after each text
    owner = np.repeat(np.arange(n), np.diff(starts))
    pairs = np.bincount(owner * _KINDS**2 + kind[:-1] * _KINDS + kind[1:], minlength=n * _KINDS**2).reshape(n, -1)
    single = pairs.reshape(n, _KINDS, _KINDS).sum(axis=1)[:, 1:]
    at, end, h = words(data)
    bound = np.searchsorted(at, starts)
    rows = []
    for i in range(n):
        own, lengths = h[bound[i] : bound[i + 1]], (end - at)[bound[i] : bound[i + 1]]
        k = len(own)
        if not k:
            rows.append((0.0,) * 8)
            continue
        _, often = np.unique(own, return_counts=True)
        runs = mix(own[:-2] + mix(own[1:-1] + mix(own[2:]))) if k > 2 else own
        rows.append((np.log1p(k), lengths.mean(), lengths.std(), lengths.max() ** 0.5, len(often) / k, often.max() / k, len(np.unique(runs)) / len(runs), (often > 1).mean()))
    whole = np.maximum(size, 1)[:, None]
    letters = single[:, 1] + single[:, 2] + single[:, 13] + single[:, 14]
    more = np.stack([np.log1p(size), size == 0, single[:, 2] / np.maximum(letters, 1), single[:, 9] / np.maximum(single[:, 3], 1), single[:, 10] / np.maximum(single[:, 4] + 1, 1)], axis=1)
    return np.concatenate([np.sqrt(single / whole), np.sqrt(pairs / whole), np.array(rows).reshape(n, 8), more], axis=1).astype(np.float32)


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.centre) / self.scale, -8, 8)
        a, b, c, d = self.weights
        return np.tanh(x @ a + b) @ c + d[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _fit(pos: np.ndarray, unl: np.ndarray, prior: float | None, centre: np.ndarray, scale: np.ndarray) -> Model:
    """With a prior by the non-negative risk; without one, positives against unlabelled rows."""
    rng = np.random.default_rng(SEED)
    d = pos.shape[1]
    model = Model(centre, scale, [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.2, HIDDEN), np.zeros(1)], prior or 0.5)
    norm = lambda x: np.clip((x - centre) / scale, -8, 8)
    pos, unl = norm(pos), norm(unl)
    first, second = ([np.zeros_like(w) for w in model.weights] for _ in range(2))
    step, steps = 0, EPOCHS * max(1, len(unl) // BATCH)
    steps = max(steps, 400)
    while step < steps:
        step += 1
        x = np.concatenate([pos[rng.integers(len(pos), size=BATCH)], unl[rng.integers(len(unl), size=BATCH)]])
        a, b, c, e = model.weights
        hidden = np.tanh(x @ a + b)
        z = hidden @ c + e[0]
        p, u = z[:BATCH], z[BATCH:]
        if prior is None:
            g = np.concatenate([_sigmoid(p) - 1, _sigmoid(u)]) / BATCH
        else:
            # logistic loss: softplus(-z) as a positive, softplus(z) as a negative
            rest = np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()
            away = np.concatenate([-prior * _sigmoid(p), _sigmoid(u)]) / BATCH
            if rest >= 0:
                g = away
                g[:BATCH] += prior * (_sigmoid(p) - 1) / BATCH
            else:
                g = -away
        back = np.outer(g, c) * (1 - hidden * hidden)
        grads = [x.T @ back + 1e-4 * a, back.sum(axis=0), hidden.T @ g + 1e-4 * c, np.array([g.sum()])]
        rate = RATE * (1 - step / (steps + 1)) ** 0.5
        for w, q, m, v in zip(model.weights, grads, first, second, strict=True):
            m += 0.1 * (q - m)
            v += 0.001 * (q * q - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def estimate_prior(pos_scores: np.ndarray, unl_scores: np.ndarray, delta: float = 0.1) -> float:
    """Least ratio of tails over all thresholds, with the margin of a uniform bound in the numerator."""
    p, u = np.sort(pos_scores), np.sort(unl_scores)
    at = np.unique(np.concatenate([p, u]))
    above_p = 1 - np.searchsorted(p, at, "left") / len(p)
    above_u = 1 - np.searchsorted(u, at, "left") / len(u)
    margin = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
    fit = above_p > 0
    best = np.argmin((above_u[fit] + 0.5 * margin) / above_p[fit])
    return float(np.clip(above_u[fit][best] / above_p[fit][best], 0.02, 0.98))


def train(pos: np.ndarray, unl: np.ndarray) -> Model:
    every = np.concatenate([pos, unl])
    centre, scale = every.mean(axis=0), every.std(axis=0) + 1e-2
    half, part = np.arange(len(pos)) % 2 == 0, np.arange(len(unl)) % 2 == 0
    if min(half.sum(), part.sum(), (~half).sum(), (~part).sum()):
        split = _fit(pos[half], unl[part], None, centre, scale)
        prior = estimate_prior(split.logits(pos[~half]), split.logits(unl[~part]))
    else:
        prior = 0.5
    return _fit(pos, unl, prior, centre, scale)


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model from rows that are not held out."""
    rows = docs.select("doc_id", "text").where(~held_out() & F.col("doc_id").isNotNull())
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("positive", F.lit(True))
    known = labels.where("quality is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("labelled", F.lit(True))
    # repeated rows have one mark, and count once
    rows = rows.withColumn("key", F.xxhash64("text", "doc_id")).withColumn("mark", F.pmod("key", F.lit(1 << 48)) / 2.0**48)
    positive, unlabelled = F.coalesce("positive", F.lit(False)), F.col("labelled").isNull()
    with_kind = lambda df: df.join(good, "doc_id", "left").join(known, "doc_id", "left")
    # distinct rows are counted, however many of them share an id, so that what is picked is bounded
    n_good, n_rest = with_kind(rows.select("doc_id", "key")).agg(F.approx_count_distinct(F.when(positive, F.col("key"))), F.approx_count_distinct(F.when(unlabelled, F.col("key")))).first()
    if not n_good:
        return None
    share_p, share_u = 1.3 * MOST / n_good, 1.3 * MOST / max(n_rest, 1)
    # ids of both kinds first, so that texts of picked rows only are measured
    picked = with_kind(rows.where(F.col("mark") < max(share_p, share_u)))
    picked = picked.where((positive & (F.col("mark") < share_p)) | (unlabelled & (F.col("mark") < share_u)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in parts(batch["text"], 1 << 19):
                cut = slice(first, first + len(texts))
                yield pa.record_batch({"kind": batch["kind"][cut], "key": batch["key"][cut], "x": pa.array([v.tobytes() for v in features(texts)], pa.binary())})

    picked = picked.select("key", positive.alias("kind"), F.col("text").cast("string").alias("text")).dropDuplicates(["kind", "key"])
    # distinct rows by now, whose number the shares hold near 1.3 times the bound; those of least key teach
    got = picked.mapInArrow(measure, "kind boolean, key long, x binary").toPandas().sort_values(["kind", "key"])
    x = np.array([np.frombuffer(v, np.float32) for v in got["x"]])
    kind = got["kind"].to_numpy(bool)
    pos, unl = x[kind][:MOST], x[~kind][:MOST] if (~kind).any() else x[:MOST]
    return train(pos, unl) if len(pos) else None


def score_quality(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(rows, labels))  # about 7,000 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in parts(batch["text"], 1 << 19):
                s = shared.value.scores(features(texts)) if shared.value else np.full(len(texts), 0.5)
                cut = slice(first, first + len(texts))
                yield pa.record_batch({"doc_id": batch["doc_id"][cut], "held_out": batch["held_out"][cut], "score": pa.array(s.astype(np.float64)), "predicted": pa.array((s >= THRESHOLD).astype(np.int32))})

    return rows.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
