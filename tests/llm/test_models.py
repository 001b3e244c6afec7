"""Operators 1 and 8: held-out accuracy on the supplied tables, and odd inputs."""

from __future__ import annotations

import os

import numpy as np
import pytest
from helpers import ODD, frame
from pyspark.sql import functions as F

from graphloom.llm import quality, toxicity, training

SF = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"
tables = pytest.mark.skipif(not os.path.exists(SF), reason="the supplied tables are not here")


@tables
@pytest.mark.parametrize(("query", "label", "least"), [(quality.op1_quality_classifier, "quality", 0.95), (toxicity.op8_toxicity, "toxic", 0.9)])
def test_held_out_accuracy(spark, query, label, least):
    scored = query(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select(F.col("doc_id").alias("l_id"), label)
    held = scored.join(labels, F.col("doc_id") == F.col("l_id")).filter("held_out").collect()
    assert scored.count() == 1000 and len(held) > 50
    assert np.mean([r.predicted == r[label] for r in held]) >= least
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in held)


@pytest.mark.parametrize("operator", [quality.quality_scores, toxicity.toxicity_scores])
def test_odd_inputs(spark, operator):
    docs = frame(spark, ODD, extra=True)
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(10)] + [(None, 1, 1), (3, None, None)], LABELS)
    rows = operator(docs, labels).collect()
    assert len(rows) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    assert len({r.score for r in rows if r.doc_id in (0, 1)}) == 1  # null counts as empty
    assert len({r.score for r in operator(docs, labels.limit(0)).collect()}) == 1
    assert operator(docs.limit(0), labels).count() == 0


def test_attention_model_learns_and_weighs():
    sample = [("good words stand here in a row " * 8, 1), ("BAD!! BAD!! " * 40, 0)] * 30
    model = quality.fit(sample, epochs=20)
    codes = quality._WordCodes()
    x, bags = quality.passage_features([quality.word_codes(t, codes) for t in (sample[0][0], sample[1][0], "")])
    good, bad, _ = model.scores(x, bags)
    assert good > 0.9 and bad < 0.1
    attention = model.forward(x, bags)["attention"]
    assert np.allclose(np.add.reduceat(attention, np.cumsum(bags) - bags), 1, atol=1e-5)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    model = toxicity.Model(np.zeros(toxicity.BUCKETS, np.float32), 0.0, np.array([[0.0, -1.2], [0.0, 0.7]]), -0.4, np.zeros(3))
    counts = np.array([6, 0, 4])
    e = [rng.normal(size=n) for n in counts]
    flat, expected = model.marginals(np.concatenate(e), counts, pairs=True)
    got = np.split(flat, np.cumsum(counts)[:-1])
    moves = np.zeros((2, 2))
    for row, n in enumerate(counts):
        if not n:
            continue
        weight, marginal = 0.0, np.zeros(n)
        pairs = np.zeros((2, 2))
        for code in range(1 << n):
            tags = np.array([code >> k & 1 for k in range(n)])
            w = np.exp((tags * e[row]).sum() + model.start * tags[0] + sum(model.move[a, b] for a, b in zip(tags[:-1], tags[1:], strict=True)))
            weight += w
            marginal += w * tags
            for a, b in zip(tags[:-1], tags[1:], strict=True):
                pairs[a, b] += w
        assert np.allclose(got[row], marginal / weight, atol=1e-9)
        moves += pairs / weight
    assert np.allclose(expected, moves, atol=1e-9)


def test_marginals_of_long_chains_are_exact():
    """Chains of several blocks against a plain forward-backward over the whole chain."""
    rng = np.random.default_rng(4)
    model = toxicity.Model(np.zeros(toxicity.BUCKETS, np.float32), 0.0, np.array([[0.0, -2.2], [0.0, 1.7]]), -1.4, np.zeros(3))
    counts = np.array([5, 128, 129, 0, 1000, 300])
    e = [rng.normal(size=n) * 3 for n in counts]
    flat, expected = model.marginals(np.concatenate(e), counts, pairs=True)
    t, moves = np.exp(model.move), np.zeros((2, 2))
    for own, scores in zip(np.split(flat, np.cumsum(counts)[:-1]), e, strict=True):
        n = len(scores)
        if not n:
            continue
        o = np.stack([np.ones(n), np.exp(scores)], axis=1)
        alpha, beta = np.zeros((n, 2)), np.ones((n, 2))
        alpha[0] = np.array([1, np.exp(model.start)]) * o[0]
        for i in range(1, n):
            alpha[i] = (alpha[i - 1] / alpha[i - 1].sum()) @ t * o[i]
        for i in range(n - 2, -1, -1):
            beta[i] = t @ (o[i + 1] * beta[i + 1])
            beta[i] /= beta[i].sum()
        both = alpha * beta
        assert np.allclose(own, both[:, 1] / both.sum(1), atol=1e-9)
        for i in range(1, n):
            joint = alpha[i - 1][:, None] * t * (o[i] * beta[i])
            moves += joint / joint.sum()
    assert np.allclose(expected, moves, atol=1e-6)


def plain_forward(model: quality.Model, passages: np.ndarray) -> float:
    """The score of one bag, passage by passage."""
    p, hidden, logits = model.weights, [], []
    for x in passages:
        h = np.tanh(np.clip((x - model.shift) * model.scale, -5, 5) @ p["w"] + p["b"])
        hidden.append(h)
        logits.append(float(sum(a * np.tanh(h @ v) / (1 + np.exp(-(h @ u))) for a, v, u in zip(p["a"], p["v"].T, p["u"].T, strict=True))))
    share = np.exp(logits) / sum(np.exp(logits))
    return float(1 / (1 + np.exp(-(sum(s * h for s, h in zip(share, hidden, strict=True)) @ p["c"] + p["d"]))))


def test_attention_equals_loops_and_its_gradients_finite_differences():
    rng = np.random.default_rng(3)
    shape = {"w": (quality.SIZE, 4), "b": (4,), "v": (4, 3), "u": (4, 3), "a": (3,), "c": (4,), "d": ()}
    model = quality.Model(rng.normal(size=quality.SIZE) * 0.1, np.ones(quality.SIZE), {k: rng.normal(0, 0.5, s) for k, s in shape.items()})
    bags, y = np.array([3, 1, 5]), np.array([1.0, 0.0, 1.0])
    x = rng.normal(size=(9, quality.SIZE)) * 0.3
    assert np.allclose(model.scores(x, bags), [plain_forward(model, part) for part in np.split(x, np.cumsum(bags)[:-1])])

    def loss() -> float:
        s = model.scores(x, bags)
        return float(-np.mean(y * np.log(s) + (1 - y) * np.log(1 - s)))

    for name, g in model.gradients(x, bags, y).items():
        for _ in range(6):
            at = tuple(rng.integers(0, k) for k in shape[name])
            weight, e = model.weights[name][at], 1e-5
            model.weights[name][at] = weight + e
            up = loss()
            model.weights[name][at] = weight - e
            down = loss()
            model.weights[name][at] = weight
            assert abs((up - down) / (2 * e) - np.asarray(g)[at]) < 1e-7


def test_tokens_go_by_script_and_not_by_length():
    for text in ("a" * 40 + "b", "詞" * 30 + "毒", "é" * 50 + "x", "latin詞語mixed", "毒", "ภาษาไทย", "a毒b", "한국어 문장", "詞a語"):
        tokens = toxicity.tokens_of(text)
        places = toxicity.token_places(text)
        raw = text.encode()
        assert [raw[a:b] for a, b in places] == tokens and places[-1][1] == len(raw)
    for n in range(2, 60):
        assert len(toxicity.tokens_of("詞" * n)) == n - 1 and len(toxicity.tokens_of("y" * n)) == 1
    assert [t.decode() for t in toxicity.tokens_of("Latin詞語文mixed한국 毒")] == ["latin", "詞語", "語文", "mixed한국", "毒"]
    assert toxicity.tokens_of("y" * 41) != toxicity.tokens_of("y" * 40 + "z")
    codes = quality._WordCodes()
    assert codes[b"a" * 80] != codes[b"a" * 79 + b"!"] and not codes


def test_equal_texts_count_once_in_the_sample_and_long_ones_whole(spark):
    texts = ["a hot text"] * 1500 + [f"text number {i}" for i in range(2000)] + ["long " * 100_000]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(len(texts))], LABELS)
    sample = list(training.training_sample(docs, labels, "quality", 3, 1, 1000))
    assert len(sample) == len(set(sample)) == 1000
    assert sample == list(training.training_sample(docs.repartition(7), labels, "quality", 3, 1, 1000))
    whole = list(training.training_sample(docs, labels, "quality", 3, 3, 10_000))
    assert len(whole) == 2002 and max(len(t) for t, _ in whole) == 500_000


def test_what_stands_late_or_between_in_long_texts_is_learned():
    """Texts of 60,000 characters that differ in one place, where eight passages from start to end wouldn't look."""
    rng = np.random.default_rng(6)
    plain = lambda n: [f"w{k}" for k in rng.integers(0, 300, n)]
    sample = []
    for k in range(60):
        words = plain(15_000)
        if k % 2:
            words[5_000:5_064] = [f"nasty{c}" for c in rng.choice(list("abcdef"), 64)]
        sample.append((" ".join(words), k % 2))
    model = toxicity.fit(sample)
    e, counts = toxicity._text_scores([t for t, _ in sample], toxicity._WordScores(model))
    scores = model.scores(model.marginals(e, counts)[0], counts)
    assert all((s >= 0.5) == bool(label) for s, (_, label) in zip(scores, sample, strict=True))
    loud = [(t.replace("nasty", "NASTY!!!!"), label) for t, label in sample]
    attention = quality.fit(loud, epochs=30)
    codes = quality._WordCodes()
    got = attention.scores(*quality.passage_features([quality.word_codes(t, codes) for t, _ in loud]))
    assert np.mean([(s >= 0.5) == bool(label) for s, (_, label) in zip(got, loud, strict=True)]) == 1


def test_training_in_parts_is_training_of_all(monkeypatch):
    rng = np.random.default_rng(8)
    sample = [(" ".join(f"w{k}" for k in rng.integers(0, 50, int(rng.integers(0, 400)))) + (" vile vilest" * (i % 2)), i % 2) for i in range(80)]
    whole = toxicity.fit(sample)
    monkeypatch.setattr(toxicity, "BLOCKS", 3)
    parts = toxicity.fit(iter(sample))
    assert np.allclose(whole.fit, parts.fit, atol=1e-3) and np.allclose(whole.move, parts.move, atol=1e-4)
    assert np.allclose(whole.emission, parts.emission, atol=1e-3)


def test_toxic_spans(spark):
    rng = np.random.default_rng(1)
    clean = lambda: [f"w{rng.integers(300)}" for _ in range(60)]
    sample = []
    for k in range(400):
        words = clean()
        if k % 2:
            for at in rng.integers(0, 60, 4):
                words[at] = "nastyword" + "abcdef"[rng.integers(6)]
        sample.append((" ".join(words), k % 2))
    model = toxicity.fit(sample)
    docs = frame(spark, ["w1 w2, Nastyworda! w3 é nastywordz", "w1 w2 w3", None, ""])
    spans = toxicity.toxic_spans(docs, model).collect()
    assert [(r.doc_id, r.start, r.stop, r.span) for r in spans] == [(0, 7, 17, "Nastyworda"), (0, 25, 35, "nastywordz")]
    scores = {r.doc_id: r.score for r in toxicity.with_scores(docs, model).collect()}
    assert scores[0] > 0.5 > max(scores[1], scores[2], scores[3])
