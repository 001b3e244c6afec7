r"""Operator 8: toxic spans by a linear-chain conditional random field.

Labels are given for documents, so tokens are labelled first: in toxic training documents, a token is toxic if one of
its features (the word, its beginnings and ends) is in at least one of a hundred toxic documents, behind as
many different words, and at least twenty times as frequent there as in clean ones, beyond what chance gives; all others are
clean. So a toxic word that is in fewer than one of a hundred toxic training documents (``support``) is learned only by its company. On these a
two-tag chain is trained (feature weights by hashing, transitions, start). Forward-backward marginals
tag the tokens of whole texts; a logistic fit turns their largest and their sum of squares into the document's score.

A document is one chain, however long: blocks of its words are summed up as 2 x 2 matrices, which carry the exact state from block
to block, so that all blocks are then worked through side by side. Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after
lower-casing A-Z. In scripts that are written without spaces, at any length, two neighbouring characters are a token (a single one by
itself); what stands between such characters is a token as it is, however long. Training takes at most ``per_label`` rows a label
(``training.training_sample``), of these too whole texts, on the driver: it holds four bytes a token, and the states of some documents at a time.

Defined results: a null or empty text has no tokens and gets the score of one without toxic tokens. A null id is not held out. Without toxic
training rows all scores are 0; without clean ones the chain decides alone. Repeated rows are scored alike. An empty table gives
no rows. ``toxicity_scores`` selects its columns by name; ``with_scores`` replaces columns named score and spans and keeps all others.
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

#: Words of a block, and blocks whose states are held at once (a longer document's are held together).
BLOCK, BLOCKS = 128, 2048
BUCKETS = 1 << 18
PER_LABEL = 2500
SUPPORT, RATIO = 0.01, 20.0
BATCH_BYTES = 4_000_000
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: UTF-8 of U+0800 and later begins with these bytes; only such words can hold characters of scripts without spaces.
_LATE = re.compile(rb"[\xe0-\xff]")
#: Scripts that are written without spaces: Thai and Lao, Burmese, Khmer, Chinese and Japanese (with their extensions).
_SPACELESS = re.compile("([\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u2E80-\u3130\u3190-\uA4CF\uF900-\uFAFF\uFF66-\uFF9F\U00020000-\U0003FFFF]+)")


def cut_word(word: bytes) -> list[tuple[int, int]]:
    """The places of a word's tokens: overlapping pairs of characters in scripts without spaces, what stands between as it is."""
    if not _LATE.search(word):
        return [(0, len(word))]
    out, at = [], 0
    for k, run in enumerate(_SPACELESS.split(word.decode())):
        if k % 2 == 0:
            end = at + len(run.encode())
            if run:
                out.append((at, end))
        else:
            ends = [at, *(at + np.cumsum([len(c.encode()) for c in run])).tolist()]
            out += [(ends[i], ends[i + 2]) for i in range(len(run) - 1)] or [(at, ends[1])]
            end = ends[-1]
        at = end
    return out


def tokens_of(text: str | None) -> list[bytes]:
    words = common.alnum_words(text)
    if not text or not _LATE.search(text.encode()):
        return words
    return [word[a:b] for word in words for a, b in cut_word(word)]


def token_places(text: str) -> list[tuple[int, int]]:
    """Where the tokens of ``tokens_of`` stand in the text's UTF-8."""
    return [(m.start() + a, m.start() + b) for m in _WORD.finditer(text.encode()) for a, b in cut_word(m[0])]


def word_features(word: bytes) -> list[int]:
    """Hashed features of a token: itself, its first 3 to 5 and its last 3 and 4 characters."""
    text = word.decode(errors="ignore")
    parts = ["w" + text] + [f"{k}<{text[:k]}" for k in (3, 4, 5)] + [f"{k}>{text[-k:]}" for k in (3, 4)]
    return [xxhash.xxh32_intdigest(p) % BUCKETS for p in parts]


@dataclass
class Model:
    """emission: weight of each feature for the toxic tag; bias; move[a, b]: from tag a to b; start; fit: the score's."""

    emission: np.ndarray
    bias: float
    move: np.ndarray
    start: float
    fit: np.ndarray
    empty: bool = False

    def word_score(self, word: bytes) -> float:
        return float(self.emission[word_features(word)].sum() + self.bias)

    def _borders(self, odds: np.ndarray, live: np.ndarray, blocks: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each block: P(toxic) of the place before it, and the odds of what follows it for toxic against clean."""
        n, first = odds.shape[1], np.cumsum(blocks) - blocks
        before, after = np.zeros(n), np.ones(n)
        long = np.flatnonzero(blocks > 1)
        if not len(long):
            return before, after
        some = np.repeat(blocks > 1, blocks)
        o, real = odds[:, some], live[:, some]
        of = np.cumsum(some) - 1  # a block's column among these
        # The product of a block's steps, row by row: from clean and from toxic; a document's first step comes from no place.
        step0 = np.where(np.isin(np.flatnonzero(some), first)[:, None, None], np.array([[1.0, np.exp(self.start)]] * 2), t)
        m = step0 * np.stack([np.ones(o.shape[1]), o[0]], axis=1)[:, None, :]
        for i in range(1, BLOCK):
            c = m[:, :, 0] * t[0, 0] + m[:, :, 1] * t[1, 0]
            x = (m[:, :, 0] * t[0, 1] + m[:, :, 1] * t[1, 1]) * o[i][:, None]
            new = np.stack([c, x], axis=2)
            m = np.where(real[i][:, None, None], new / new.sum((1, 2), keepdims=True), m)
        state = np.tile([1.0, 0.0], (len(long), 1))
        for k in range(int(blocks.max()) - 1):
            on = np.flatnonzero(blocks[long] > k + 1)
            at = first[long[on]] + k
            state[on] = np.einsum("na,nab->nb", state[on], m[of[at]])
            state[on] /= state[on].sum(1, keepdims=True)
            before[at + 1] = state[on, 1]
        ahead = np.ones((len(long), 2))
        for k in range(1, int(blocks.max())):
            on = np.flatnonzero(blocks[long] > k)
            at = first[long[on]] + blocks[long[on]] - k
            ahead[on] = np.einsum("nab,nb->na", m[of[at]], ahead[on])
            ahead[on] /= ahead[on].sum(1, keepdims=True)
            after[at - 1] = ahead[on, 1] / ahead[on, 0]
        return before, after

    def _marginals(self, e: np.ndarray, counts: np.ndarray, pairs: bool) -> tuple[np.ndarray, np.ndarray]:
        blocks = -(-counts // BLOCK)
        n = int(blocks.sum())
        first = np.cumsum(blocks) - blocks
        place = np.arange(len(e)) - np.repeat(np.cumsum(counts) - counts, counts)
        row = np.repeat(first, counts) + place // BLOCK
        odds, live = np.ones((BLOCK, n)), np.zeros((BLOCK, n), bool)
        odds[place % BLOCK, row] = np.exp(np.clip(e, -30, 30))
        live[place % BLOCK, row] = True
        t = np.exp(self.move - self.move.max())
        before, after = self._borders(odds, live, blocks, t)
        opening = np.zeros(n, bool)
        opening[first[blocks > 0]] = True

        forward, backward = np.zeros((BLOCK, n)), np.ones((BLOCK, n))  # P(toxic | words so far); toxic against clean
        up = np.where(opening, np.exp(self.start), before * t[1, 1] + (1 - before) * t[0, 1]) * odds[0]
        forward[0] = up / (up + np.where(opening, 1, before * t[1, 0] + (1 - before) * t[0, 0]))
        for i in range(1, BLOCK):
            f = forward[i - 1]
            up = (f * t[1, 1] + (1 - f) * t[0, 1]) * odds[i]
            forward[i] = up / (up + f * t[1, 0] + (1 - f) * t[0, 0])
        backward[-1] = after
        for i in range(BLOCK - 2, -1, -1):
            b = odds[i + 1] * backward[i + 1]
            backward[i] = np.where(live[i + 1], (t[1, 1] * b + t[1, 0]) / (t[0, 1] * b + t[0, 0]), 1)
        out = forward * backward
        out /= out + 1 - forward
        expected = np.zeros((2, 2))
        if pairs:
            for i in range(BLOCK):
                f, there = (before, live[0] & ~opening) if i == 0 else (forward[i - 1], live[i])
                f, b = f[there], (odds[i] * backward[i])[there]
                joint = np.stack([(1 - f) * t[0, 0], (1 - f) * t[0, 1] * b, f * t[1, 0], f * t[1, 1] * b])
                expected += (joint / joint.sum(0)).sum(1).reshape(2, 2)
        return out[place % BLOCK, row], expected

    def marginals(self, e: np.ndarray, counts: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """P(toxic) of each token, by toxic-against-clean scores e of documents of ``counts`` tokens; with ``pairs`` the expected moves."""
        out, expected = np.zeros(len(e)), np.zeros((2, 2))
        ends = np.cumsum(counts)
        for part in common.chunks_by_bytes(-(-counts // BLOCK), BLOCKS):
            a, b = int(ends[part.start] - counts[part.start]), int(ends[part.stop - 1])
            if b > a:
                out[a:b], some = self._marginals(np.asarray(e[a:b], float), counts[part], pairs)
                expected += some
        return out, expected

    @staticmethod
    def document_features(p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """(1, largest marginal, log of their sum of squares) of each document."""
        out = np.zeros((len(counts), 3))
        out[:, 0] = 1
        some = counts > 0
        if some.any():
            starts = (np.cumsum(counts) - counts)[some]
            out[some, 1] = np.maximum.reduceat(p, starts)
            out[some, 2] = np.log1p(np.add.reduceat(p * p, starts))
        return out

    def scores(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if self.empty:
            return np.zeros(len(counts))
        return 1 / (1 + np.exp(-np.clip(self.document_features(p, counts) @ self.fit, -30, 30)))


def fit(sample: Iterable[tuple[str, int]], rounds: int = 30, rate: float = 0.3, decay: float = 1e-6, support: float = SUPPORT) -> Model:
    """Label the tokens, train the chain by Adagrad over all documents, some at a time, then fit the score."""
    model = Model(np.zeros(BUCKETS, np.float32), -4.0, np.array([[0.0, -2.0], [0.0, -1.0]]), -2.0, np.array([-4.0, 8.0, 0.5]))
    number: dict[bytes, int] = {}
    bags, given = [], []
    for text, label in sample:
        found = tokens_of(text)
        bags.append(np.fromiter((number.setdefault(w, len(number)) for w in found), np.int32, len(found)))
        given.append(label)
    y = np.array(given, np.int64)
    if not y.sum():
        model.empty = True
        return model
    counts = np.array([len(b) for b in bags], np.int64)
    features = np.array([word_features(w) for w in number], np.int32).reshape(-1, 6)
    words = len(number)
    del number

    seen = np.zeros((2, BUCKETS), np.int64)
    for bag, label in zip(bags, given, strict=True):
        seen[label, np.unique(features[np.unique(bag)])] += 1
    toxic, clean = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    # So often that chance, over all features, would hardly give it to one that toxicity has nothing to do with.
    chance = -np.log(min(0.9, toxic / (toxic + clean)))
    least = max(3, support * toxic, np.log(10 * max(1, int((seen.sum(0) > 0).sum()))) / chance)
    marked = (seen[1] >= least) & (seen[1] / toxic >= RATIO * (seen[0] + 0.1) / clean)
    # Copies of one document repeat its words in the same places; words of a kind stand in many places.
    hot, around = marked[features].any(axis=1), []
    for bag, label in zip(bags, given, strict=True):
        at = np.flatnonzero(hot[bag]) if label else []
        if len(at):
            before = np.concatenate([[-1], bag[:-1]]).astype(np.int64)[at]
            around.append(np.unique(features[bag[at]].astype(np.int64) * (words + 1) + before[:, None] + 1))
    around = np.unique(np.concatenate(around)) if around else np.zeros(0, np.int64)
    marked &= np.bincount(around // (words + 1), minlength=BUCKETS) >= least
    del around
    # Features of few documents of either kind are left without a weight.
    usable = (seen.sum(0) >= 5) & (marked | (seen[0] > 0))
    hot = marked[features].any(axis=1)
    parts = list(common.chunks_by_bytes(-(-counts // BLOCK), BLOCKS))
    # What is labelled stays the same from round to round: how often each word, each first word and each move is toxic.
    told, toxic_words, toxic_first, size = np.zeros((2, 2)), np.zeros(words), 0, int(counts.sum())
    for bag, label in zip(bags, given, strict=True):
        tags = hot[bag] if label else np.zeros(len(bag), bool)
        told += np.bincount(2 * tags[:-1] + tags[1:], minlength=4).reshape(2, 2)
        toxic_first += int(tags[:1].sum())
        if label:
            toxic_words += np.bincount(bag, tags, words)

    squares, other = np.full(BUCKETS, 1e-3, np.float32), np.full(6, 1e-3)
    rng = np.random.default_rng(7)
    for turn in range(rounds):
        # Every other round leaves features out, so that a word's beginning is enough for forms not seen before.
        some = np.flatnonzero(rng.random(features.shape[1]) < 0.5) if turn % 2 else np.arange(features.shape[1])
        used = features[:, some if len(some) else [1]]
        word_score = model.emission[used].sum(1) + model.bias
        by_word, opening, expected = toxic_words.copy(), float(toxic_first), np.zeros((2, 2))
        for part in parts:
            tokens = np.concatenate(bags[part])
            p, moves = model.marginals(word_score[tokens], counts[part], pairs=True)
            by_word -= np.bincount(tokens, p, words)
            opening -= p[(np.cumsum(counts[part]) - counts[part])[counts[part] > 0]].sum()
            expected += moves
        g = np.bincount(used.ravel(), np.repeat(by_word, used.shape[1]), BUCKETS).astype(np.float32)
        g -= decay * size / BLOCK * model.emission
        g[~usable] = 0
        squares += g * g
        model.emission += (rate * g / np.sqrt(squares)).astype(np.float32)
        small = np.array([by_word.sum(), opening, *(told - expected).ravel()]) / max(1, size) * 1e3
        other += small**2
        step = rate * small / np.sqrt(other)
        model.bias += step[0]
        model.start += step[1]
        model.move = model.move + step[2:].reshape(2, 2)
        model.move[:, 0] = 0  # moves to the toxic tag against moves to the clean one
    word_score, x = model.emission[features].sum(1) + model.bias, []
    for part in parts:
        p, _ = model.marginals(word_score[np.concatenate(bags[part])], counts[part])
        x.append(model.document_features(p, counts[part]))
    x = np.concatenate(x)
    weight = np.where(y == 1, 0.5 / toxic, 0.5 / clean) * len(y) if clean and toxic else np.ones(len(y))
    beta = np.zeros(3)
    for _ in range(30):  # Newton's method with a small ridge
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (weight * q * (1 - q))[:, None]).T @ x + 1.0 * np.eye(3)
        beta = beta + np.linalg.solve(hessian, x.T @ (weight * (y - q)) - 1.0 * beta)
    model.fit = beta
    return model


class _WordScores(dict):
    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: bytes) -> float:
        value = self.model.word_score(word)
        if len(word) <= common.LONG_WORD:
            if len(self) >= 250_000:
                self.clear()
            self[word] = value
        return value


def _text_scores(texts: list[str | None], scores: _WordScores) -> tuple[np.ndarray, np.ndarray]:
    words, counts = [], []
    for text in texts:
        found = tokens_of(text)
        words += found
        counts.append(len(found))
    return np.fromiter(map(scores.__getitem__, words), np.float64, len(words)), np.array(counts, np.int64)


def spans_in(text: str, p: np.ndarray, least: float) -> list[tuple[int, int, float]]:
    """(start, stop, marginal) of each run of tokens with marginals of at least ``least``; places in UTF-8 bytes."""
    places = token_places(text)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], p >= least, [False]]).astype(np.int8)))
    return [(places[a][0], places[b - 1][1], float(p[a:b].max())) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]


def with_scores(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """``docs`` with ``score`` and ``spans`` (start, stop, marginal: offending places, as ``spans_in``), from the column text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB
    scores = common.lazily(lambda: _WordScores(shared.value))
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("marginal", pa.float64())])
    (found,) = common.free_names(docs, "found")

    @F.arrow_udf("struct<score:double,spans:array<struct<start:bigint,stop:bigint,marginal:double>>>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        common.trim()
        for column in batches:
            out, spans = [np.zeros(0)], []
            for part in common.chunks_by_bytes(common.byte_lengths(column), BATCH_BYTES):
                texts = column[part.start : part.stop].to_pylist()
                e, counts = _text_scores(texts, scores())
                p, _ = shared.value.marginals(e, counts)
                if shared.value.empty:
                    p[:] = 0
                x = shared.value.document_features(p, counts)
                out.append(shared.value.scores(p, counts))
                ends = np.cumsum(counts)
                spans += [
                    [dict(zip(("start", "stop", "marginal"), s, strict=True)) for s in spans_in(text, p[end - n : end], least)] if hot else []
                    for text, end, n, hot in zip(texts, ends.tolist(), counts.tolist(), (x[:, 1] >= least).tolist(), strict=True)
                ]
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(out)), pa.array(spans, pa.list_(span))], ["score", "spans"])

    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("score", "spans")]
    return docs.withColumn(found, score(F.col("text"))).select(*others, f"{found}.score", f"{found}.spans")


def toxic_spans(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """(doc_id, start, stop, span, marginal): runs of tokens whose marginal is at least ``least``; byte offsets in UTF-8."""
    each = with_scores(docs.select("doc_id", "text"), model, least).select("doc_id", "text", F.explode("spans").alias("s"))
    raw = F.encode("text", "UTF-8")
    return each.select(
        "doc_id", "s.start", "s.stop",
        F.decode(F.substring(raw, F.col("s.start") + 1, F.col("s.stop") - F.col("s.start")), "UTF-8").alias("span"), "s.marginal",
    )


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, support: float = SUPPORT) -> Model:
    return fit(training_sample(docs, labels, "toxic", 5, 0, per_label), support=support)


def toxicity_scores(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) of each row of ``docs``."""
    model = model or train(docs, labels)
    return with_scores(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(F.pmod(common.crc32_of_id(), F.lit(5)) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans",
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
