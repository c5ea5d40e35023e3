"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads a text's bytes (UTF-8, letters of A-Z lowered) in both directions, labels every position
with a distribution over the languages, and a document's probabilities are the mean over its positions that
belong to a letter. It is trained in numpy by backpropagation through time on a bounded sample of labelled
rows, and then read by every task.

Whole texts are read: a text is cut into windows of ``WINDOW`` bytes, and thousands of windows advance in step,
so one matrix product serves them all. Either direction starts ``LEAD`` bytes outside the window; the states
of those bytes warm the network up and give no label. By then the states hardly depend on where they began: a test
holds scores against those of one recurrence over each whole text. No window reaches into another text.

Defined cases: a text that is null or has no letter gets the language ``und`` and score 0; rows with a null
lang or a null text teach nothing; without any labelled row all texts get ``und``; a single language needs no
network and scores 1. Texts of any length pass in pieces. Lang, source and doc_id are never inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxtone.llm.common import held_out, small_batches, stored
from fluxtone.llm.textops import joined, parts

UNKNOWN = "und"
WINDOW, LEAD = 96, 16
#: Windows that advance in step.
SIDE_BY_SIDE = 2048
#: Bounds of the training sample: distinct texts of each language, and windows of each text.
ROWS_EACH, WINDOWS_EACH = 400, 3
#: Up to so many languages training takes ``STEPS`` steps and scoring ``SIDE_BY_SIDE`` windows; with more, in proportion more and less.
FEW_LANGUAGES = 64
HIDDEN, STEPS, BATCH, RATE = 8, 300, 128, 0.03

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@lru_cache(maxsize=1)
def _letter_table() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def letters(data: bytes) -> np.ndarray:
    """For each byte of UTF-8 text, whether it belongs to a letter of any script. Bytes that are no text don't."""
    points = np.frombuffer(data.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.full(len(points), 4)
    size[points < 0x10000] = 3
    size[points < 0x800] = 2
    size[(points < 0x80) | ((points >= 0xDC80) & (points < 0xDD00))] = 1
    return np.repeat(_letter_table()[points], size)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Weights of both directions, stacked: a table row for each byte and direction, recurrent maps, and the labels' map."""

    languages: list[str]
    table: np.ndarray  # 2 x 256 x 3H: what a byte adds to update, reset and candidate
    hidden: np.ndarray  # 2 x 3H x H
    bias: np.ndarray  # 2 x H: of the candidate's recurrent part
    out: np.ndarray  # C x 2H
    out_bias: np.ndarray  # C

    @classmethod
    def start(cls, languages: list[str], seed: int = 7) -> Network:
        rng, h, c = np.random.default_rng(seed), HIDDEN, len(languages)
        f = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        table = f(2, 256, 3 * h, scale=0.4)
        table[:, :, :h] += 1.0  # keep most of the old state at first
        return cls(languages, table, f(2, 3 * h, h, scale=0.4), np.zeros((2, h), np.float32), f(c, 2 * h, scale=0.3), np.zeros(c, np.float32))

    def weights(self) -> list[np.ndarray]:
        return [self.table, self.hidden, self.bias, self.out, self.out_bias]

    def states(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """T x 2H x B states for T x B bytes."""
        t, b = x.shape
        h, states, at = HIDDEN, np.empty((t, 2 * HIDDEN, b), np.float32), x.astype(np.intp)
        for d in range(2):
            now = np.zeros((h, b), np.float32)
            table, hidden, bias = np.ascontiguousarray(self.table[d].T), self.hidden[d], self.bias[d][:, None]
            for s in range(t) if d == 0 else range(t - 1, -1, -1):
                given, back = np.take(table, at[s], axis=1, mode="clip"), hidden @ now
                zr = given[: 2 * h]
                zr += back[: 2 * h]
                zr *= 0.5
                np.tanh(zr, out=zr)
                zr *= 0.5
                zr += 0.5
                z, r = zr[:h], zr[h:]
                inner = back[2 * h :]
                inner += bias
                new = r * inner
                new += given[2 * h :]
                np.tanh(new, out=new)
                if keep is not None:
                    keep.append((d, s, now, z, r, inner, new))
                now = new + z * (now - new)
                states[s, d * h : (d + 1) * h] = now
        return states

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        """T x C x B."""
        y = np.matmul(self.out, states)
        y += self.out_bias[:, None]
        y -= y.max(axis=1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(axis=1, keepdims=True)
        return y

    def gradients(self, x: np.ndarray, goal: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross entropy over positions (weight: T x B), by backpropagation through time."""
        h, keep = HIDDEN, []
        states = self.states(x, keep)
        dy = self.probabilities(states)
        dy[:, goal, np.arange(x.shape[1])] -= 1
        dy *= (weight / max(weight.sum(), 1))[:, None, :]
        d_out = np.einsum("tcb,thb->ch", dy, states)
        d_states = np.matmul(self.out.T, dy)
        d_table, d_hidden, d_bias = np.zeros_like(self.table), np.zeros_like(self.hidden), np.zeros_like(self.bias)
        carry = np.zeros((h, x.shape[1]), np.float32)
        last = None
        for d, s, before, z, r, inner, new in reversed(keep):
            if d != last:
                carry, last = np.zeros_like(carry), d
            g = d_states[s, d * h : (d + 1) * h] + carry
            d_new = g * (1 - z) * (1 - new * new)
            d_inner = d_new * r
            pre = np.concatenate([g * (before - new) * z * (1 - z), d_new * inner * r * (1 - r), d_inner])
            d_hidden[d] += pre @ before.T
            d_bias[d] += d_inner.sum(axis=1)
            carry = g * z + self.hidden[d].T @ pre
            into = np.concatenate([pre[: 2 * h], d_new])
            np.add.at(d_table[d], x[s], into.T)
        return [d_table, d_hidden, d_bias, d_out, dy.sum(axis=(0, 2))]


def train(texts: list[bytes], labels: list[str], seed: int = 7) -> Network:
    """Adam over random batches of windows; languages count alike."""
    languages = sorted(set(labels))
    net = Network.start(languages, seed)
    if len(languages) < 2:
        return net
    rng = np.random.default_rng(seed)
    span = WINDOW + 2 * LEAD
    x = np.full((len(texts), span), 0x20, np.uint8)
    letter = np.zeros((len(texts), span), np.float32)
    for i, t in enumerate(texts):
        cut = np.frombuffer(t[:span], np.uint8)
        x[i, : len(cut)], letter[i, : len(cut)] = cut, letters(t[:span])
    number = {v: c for c, v in enumerate(languages)}
    x, y = _LOWER[x], np.array([number[v] for v in labels])
    groups = [np.flatnonzero(y == c) for c in range(len(languages))]
    first = [np.zeros_like(w) for w in net.weights()]
    second = [np.zeros_like(w) for w in net.weights()]
    steps = STEPS * max(len(languages), FEW_LANGUAGES) // FEW_LANGUAGES
    for step in range(1, steps + 1):
        pick = np.array([rng.choice(groups[c]) for c in rng.integers(len(languages), size=BATCH)])
        batch = np.ascontiguousarray(x[pick].T)
        rate = RATE * (1 - step / (steps + 1)) ** 0.5
        for w, g, m, v in zip(net.weights(), net.gradients(batch, y[pick], np.ascontiguousarray(letter[pick].T)), first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def score_texts(net: Network, texts: list[bytes | None]) -> np.ndarray:
    """Texts x languages: mean probabilities over letter positions, and zeros for texts without one."""
    data, starts = joined(texts)
    total, count = np.zeros((len(texts), len(net.languages))), np.zeros(len(texts))
    buf, is_letter = _LOWER[np.frombuffer(data, np.uint8)], letters(data)
    sizes = np.array([len(t or b"") for t in texts])
    each = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(texts)), each)
    begin = starts[:-1][owner] + WINDOW * (np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each))
    ahead = np.arange(-LEAD, WINDOW + LEAD)[:, None]
    side = max(1, SIDE_BY_SIDE * FEW_LANGUAGES // max(len(net.languages), FEW_LANGUAGES))
    for a in range(0, len(owner), side):
        who = owner[a : a + side]
        at = begin[a : a + side] + ahead
        inside = (at >= starts[who]) & (at < starts[who] + sizes[who])
        x = np.where(inside, buf[np.where(inside, at, 0)], np.uint8(0x20))  # T x B
        own = slice(LEAD, LEAD + WINDOW)
        letter = (is_letter[np.where(inside[own], at[own], 0)] & inside[own]).astype(np.float32)
        p = net.probabilities(net.states(x)[own])  # T x C x B
        p *= letter[:, None]
        np.add.at(total, who, p.sum(axis=0).T)
        np.add.at(count, who, letter.sum(axis=0))
    return total / np.maximum(count, 1)[:, None]


def _chosen(rows: DataFrame) -> list:
    """lang and limit for every language: texts whose hash is up to it are its ``ROWS_EACH`` least distinct ones."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            coded = batch["lang"].dictionary_encode()
            which, marks = coded.indices.to_numpy(), batch["mark"].to_numpy()
            by = np.argsort(which, kind="stable")
            cuts = np.searchsorted(which[by], np.arange(len(coded.dictionary) + 1))
            for lang, a, b in zip(coded.dictionary.to_pylist(), cuts, cuts[1:], strict=False):
                held[lang] = np.unique(np.concatenate([held.get(lang, marks[:0]), marks[by[a:b]]]))[:ROWS_EACH]
        for lang, marks in held.items():
            yield pa.record_batch({"lang": pa.array([lang] * len(marks), pa.string()), "mark": pa.array(marks, pa.int64())})

    # steps of an eighth of a power of two from the least hash on, so that few hashes lie in the step of the last one wanted
    step = F.floor(F.log2(F.col("mark").cast("double") + 2.0**63 + 1) * 8)
    found = stored(rows.select("lang", "mark").mapInArrow(least, "lang string, mark long").distinct().withColumn("step", step), "marks")
    so_far = F.sum("n").over(Window.partitionBy("lang").orderBy("step"))
    steps = found.groupBy("lang", "step").agg(F.count("*").alias("n")).withColumn("before", so_far - F.col("n")).where(F.col("before") < ROWS_EACH)  # at most 512 rows a language
    found = found.join(steps.select("lang", "step"), ["lang", "step"], "left_semi")
    order = F.row_number().over(Window.partitionBy("lang").orderBy("mark"))
    return found.withColumn("k", order).where(F.col("k") <= ROWS_EACH).groupBy("lang").agg(F.max("mark").alias("limit")).collect()  # a row a language


def fit(docs: DataFrame) -> Network:
    """The network for all the languages of the rows that are not held out."""
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(~held_out() & F.col("lang").isNotNull() & (F.length("text") > 0))
    rows = rows.select("lang", "text", F.xxhash64("text").alias("mark"))
    limits = {r.lang: r.limit for r in _chosen(rows)}
    if not limits:
        return Network.start([])
    span = WINDOW + 2 * LEAD
    spark = docs.sparkSession
    known = F.broadcast(spark.createDataFrame(list(limits.items()), "lang string, limit long"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # of at most ROWS_EACH texts of each language
        for batch in batches:
            out = []
            for lang, text, mark in zip(*(batch[c].to_pylist() for c in ("lang", "text", "mark")), strict=True):
                if (lang, mark) not in seen:
                    seen.add((lang, mark))
                    raw = text.encode()
                    starts = sorted({len(raw) * k // WINDOWS_EACH for k in range(WINDOWS_EACH)} if len(raw) > WINDOWS_EACH * span else {0})
                    out.append((lang, mark, [raw[s : s + span] for s in starts]))
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.list_(pa.binary())), strict=True)], names=["lang", "mark", "cuts"])

    sample = rows.join(known, "lang").where("mark <= limit").select("lang", "text", "mark").mapInArrow(cut, "lang string, mark long, cuts array<binary>")
    sample = sample.groupBy("lang", "mark").agg(F.min("cuts").alias("cuts")).select("lang", F.explode("cuts").alias("cut"))
    got = sample.toPandas().sort_values(["lang", "cut"])
    return train(got["cut"].tolist(), got["lang"].tolist())


def _predict(net: Network, column: pa.Array) -> tuple[list[str], list[float]]:
    """Language and score of each text of a column."""
    has_letter = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    names, scores = [], []
    for first, texts in parts(column, 1 << 19):
        if not net.languages:
            best, top = np.zeros(len(texts), int), np.zeros(len(texts))
        else:
            p = score_texts(net, texts)
            best, top = p.argmax(axis=1), p.max(axis=1)
        for i in range(len(texts)):
            known = has_letter[first + i] and bool(net.languages)
            names.append(net.languages[best[i]] if known else UNKNOWN)
            scores.append(float(top[i]) if known else 0.0)
    return names, scores


def identify(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    shared = docs.sparkSession.sparkContext.broadcast(net or fit(rows))  # some thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = _predict(shared.value, batch["text"])
            yield pa.record_batch({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())})

    return rows.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, least: float = 0.5, net: Network | None = None) -> DataFrame:
    """The rows of ``docs`` in a language that is known with a score of ``least`` or more, with all their columns.

    Where no language was learned, those with a letter.
    """
    small_batches(docs.sparkSession)
    net = net or fit(docs)
    if not net.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = _predict(shared.value, batch["text"])
            yield batch.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
