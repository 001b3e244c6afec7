r"""Operator 1: quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Every passage is encoded: hashed word shapes (what a word looks
like, its case, digits and marks), hashed lower-cased words and a few surface figures, then a learned
hidden layer. Gated attention (tanh times sigmoid) weighs the passages of a document; the weighted
sum of their hidden vectors is scored. All weights are learned from document labels alone, on the driver, from
a sample of at most ``per_label`` rows a label (``training.training_sample``), in mini-batches. Of these too whole texts are read; the
driver holds eight bytes a word of them. A word's length, marks and capitals count up to 255 each in the figures.

Defined results: a null or empty text is a bag of one empty passage, so it has a score too. A training
sample of one label only gives that label's share as the score of all; without any labels it is 0.5. A null id is not held out.
Repeated rows are scored alike, and an empty table gives no rows. The inputs of a score are the text alone. ``quality_scores``
selects its columns by name; ``with_scores`` replaces a column named score and keeps all others as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common
from graphloom.llm.training import training_sample

PASSAGE = 64
SHAPES, WORDS = 96, 160
SIZE = SHAPES + WORDS + 7
HIDDEN, GATES = 32, 16
PER_LABEL = 3000
BATCH_BYTES = 4_000_000

_RUNS = [(re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[0-9]+"), b"0"), (re.compile(rb"([^A-Za-z0-9\x80-\xff])\1+"), rb"\1\1")]
_UPPER = bytes(range(65, 91))
_ALNUM = bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])


class _WordCodes(dict):
    """A word's shape bucket, word bucket and figures, packed into one number; emptied when full, long words are not kept."""

    def __missing__(self, word: bytes) -> int:
        shape = word
        for pattern, by in _RUNS:
            shape = pattern.sub(by, shape)
        marks = min(len(word.translate(None, _ALNUM)), 255)
        upper = min(len(word) - len(word.translate(None, _UPPER)), 255)
        code = xxhash.xxh32_intdigest(shape) % SHAPES
        code = code << 8 | xxhash.xxh32_intdigest(word.lower(), 1) % WORDS
        code = code << 8 | min(len(word), 255)
        code = (code << 8 | marks) << 8 | upper
        if len(word) <= common.LONG_WORD:
            if len(self) >= 250_000:
                self.clear()
            self[word] = code
        return code


def word_codes(text: str | None, codes: _WordCodes) -> tuple[np.ndarray, int]:
    """The codes of a text's words, and its number of line feeds: all that its passages' features are made of."""
    words = (text or "").encode().split()
    return np.fromiter(map(codes.__getitem__, words), np.int64, len(words)), (text or "").count("\n")


def passage_features(coded: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The features of all passages of the coded texts, and each text's number of passages (one at least)."""
    n = np.array([len(words) for words, _ in coded], np.int64)
    lines = np.array([count for _, count in coded], np.int64)
    bags = np.maximum(1, -(-n // PASSAGE))
    first = np.cumsum(bags) - bags
    packed = np.concatenate([np.zeros(0, np.int64), *(words for words, _ in coded)])
    place = np.arange(len(packed)) - np.repeat(np.cumsum(n) - n, n)
    passage = np.repeat(first, n) + place // PASSAGE
    total = int(bags.sum())
    out = np.zeros((total, SIZE), np.float32)
    size = np.bincount(passage, minlength=total)
    scale = 1 / np.maximum(size, 1)
    out[:, :SHAPES] = np.bincount(passage * SHAPES + (packed >> 32), minlength=total * SHAPES).reshape(total, SHAPES)
    out[:, SHAPES : SHAPES + WORDS] = np.bincount(passage * WORDS + (packed >> 24 & 255), minlength=total * WORDS).reshape(total, WORDS)
    out[:, : SHAPES + WORDS] *= scale[:, None]
    letters = np.bincount(passage, packed >> 16 & 255, total) * scale
    marks = np.bincount(passage, packed >> 8 & 255, total) * scale
    upper = np.bincount(passage, packed & 255, total) * scale
    again = np.zeros(len(packed), bool)
    again[1:] = (packed[1:] == packed[:-1]) & (place[1:] > 0)
    again = np.bincount(passage, again, total) * scale
    by_document = np.repeat(lines / np.maximum(n, 1), bags)
    figures = [letters / 10, marks / 4, upper / 4, again, size / PASSAGE, by_document, np.repeat(np.log1p(n) / 8, bags)]
    out[:, SHAPES + WORDS :] = np.stack(figures, axis=1)
    return out, bags


@dataclass
class Model:
    """Weights of the encoder (w, b), the attention (v, u, a) and the scorer (c, d); features are shifted and scaled."""

    shift: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    constant: float | None = None

    def forward(self, x: np.ndarray, bags: np.ndarray) -> dict[str, np.ndarray]:
        p = self.weights
        starts = np.cumsum(bags) - bags
        x = np.clip((x - self.shift) * self.scale, -5, 5)
        h = np.tanh(x @ p["w"] + p["b"])
        v, u = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        logits = (v * u) @ p["a"]
        e = np.exp(logits - np.repeat(np.maximum.reduceat(logits, starts), bags))
        attention = e / np.repeat(np.add.reduceat(e, starts), bags)
        z = np.add.reduceat(attention[:, None] * h, starts)
        return {"x": x, "h": h, "v": v, "u": u, "attention": attention, "z": z, "score": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))}

    def scores(self, x: np.ndarray, bags: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(bags), self.constant)
        return self.forward(x, bags)["score"].astype(float)

    def gradients(self, x: np.ndarray, bags: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss of the documents, by each weight."""
        p, f = self.weights, self.forward(x, bags)
        back = (f["score"] - y) / len(y)
        dz = back[:, None] * p["c"]
        of = np.repeat(np.arange(len(y)), bags)
        da = ((f["h"] - f["z"][of]) * dz[of]).sum(1) * f["attention"]
        dg = da[:, None] * p["a"]
        dv, du = dg * f["u"] * (1 - f["v"] ** 2), dg * f["v"] * f["u"] * (1 - f["u"])
        dh = (f["attention"][:, None] * dz[of] + dv @ p["v"].T + du @ p["u"].T) * (1 - f["h"] ** 2)
        return {
            "w": f["x"].T @ dh, "b": dh.sum(0), "v": f["h"].T @ dv, "u": f["h"].T @ du,
            "a": (f["v"] * f["u"]).T @ da, "c": f["z"].T @ back, "d": back.sum(),
        }


def fit(sample: Iterable[tuple[str, int]], epochs: int = 12, batch: int = 128, rate: float = 4e-3, decay: float = 1e-4, seed: int = 5) -> Model:
    """Learn all weights by Adam on the log loss of document labels; both labels weigh as their rows do."""
    codes, coded, given = _WordCodes(), [], []
    for text, label in sample:
        coded.append(word_codes(text, codes))
        given.append(label)
    y = np.array(given, np.float32)
    empty = Model(np.zeros(SIZE, np.float32), np.ones(SIZE, np.float32), {}, 0.5)
    if len(set(given)) < 2:
        empty.constant = float(y.mean()) if len(y) else 0.5
        return empty
    rng = np.random.default_rng(seed)
    shape = {"w": (SIZE, HIDDEN), "b": (HIDDEN,), "v": (HIDDEN, GATES), "u": (HIDDEN, GATES), "a": (GATES,), "c": (HIDDEN,), "d": ()}
    weights = {k: (rng.normal(0, 1 / np.sqrt(s[0]), s) if s else np.zeros(())).astype(np.float32) for k, s in shape.items()}
    count, sums, squares = 0, np.zeros(SIZE), np.zeros(SIZE)
    for k in range(0, len(y), batch):
        x = passage_features(coded[k : k + batch])[0].astype(float)
        count, sums, squares = count + len(x), sums + x.sum(0), squares + (x * x).sum(0)
    mean = sums / count
    spread = np.sqrt(np.maximum(squares / count - mean**2, 0))
    model = Model(mean.astype(np.float32), (1 / (spread + 0.02)).astype(np.float32), weights)
    first = {k: np.zeros_like(w) for k, w in weights.items()}
    second = {k: np.zeros_like(w) for k, w in weights.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y)).tolist()
        for k in range(0, len(y), batch):
            docs = order[k : k + batch]
            step += 1
            for name, g in model.gradients(*passage_features([coded[d] for d in docs]), y[docs]).items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.99 * second[name] + 0.01 * g * g
                move = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)
                weights[name] = (weights[name] - rate * (move + decay * weights[name])).astype(np.float32)
    return model


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score``, from the column text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some 40 kB
    codes = common.lazily(_WordCodes)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        common.trim()
        for texts in batches:
            out = [np.zeros(0)]
            for part in common.chunks_by_bytes(common.byte_lengths(texts), BATCH_BYTES):
                coded = [word_codes(text, codes()) for text in texts[part.start : part.stop].to_pylist()]
                out.append(shared.value.scores(*passage_features(coded)))
            yield pa.array(np.concatenate(out))

    return docs.withColumn("score", score(F.col("text")))


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    return fit(training_sample(docs, labels, "quality", 3, 1, per_label))


def quality_scores(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``."""
    model = model or train(docs, labels)
    return with_scores(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(F.pmod(common.crc32_of_id(), F.lit(3)) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
