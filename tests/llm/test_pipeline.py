"""corpus_pipeline: each stage on its own input against brute force, and the whole run."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import CLASHES, DOCS, ODD, components, frame
from pyspark.sql import functions as F
from test_pairs import contaminated, copies, deduplicated
from tokenizers import Tokenizer

import corpus_pipeline
from graphloom.llm import quality

COLUMNS = list(corpus_pipeline.COLUMNS)
ITEM = " ".join(f"item{i}" for i in range(20))


def texts() -> list:
    """Good and bad prose, near copies, repeated lines, a benchmark passage, and odd texts."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    out = [prose(80) + "." for _ in range(60)] + ["!!! BUY $$$ " * 20 + str(k) for k in range(60)]
    out += copies(2, 8, 4, 40, 1)
    shared = "\n".join(prose(20) for _ in range(4))
    out += [f"{prose(30)}\n{shared}\n{prose(30)}" for _ in range(6)]
    out += [ITEM.upper() + " " + prose(40), ITEM + " " + prose(900), prose(10)] + ODD + ["y" * 2_000_000, "many words " * 100_000]
    return out


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """The tables of a small corpus, with a null id, a repeated row and clashing columns."""
    root = f"file://{tmp_path_factory.mktemp('corpus')}"
    all_texts = texts()
    docs = frame(spark, all_texts)
    more = spark.createDataFrame([(None, "a text without an id", None, None, None), (0, all_texts[0], "en", "src0", 5)], DOCS)
    docs.unionAll(more).select("*", *[F.lit("own").alias(c) for c in CLASHES]).write.parquet(f"{root}/documents.parquet")
    docs.limit(0).write.parquet(f"{root}/empty.parquet")
    labels = [(i, int(i < 60), i % 2) for i in range(120)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_quality_stage_keeps_whom_the_classifier_accepts(spark, sf_dir):
    docs = documents(spark, sf_dir)
    kept = rows_of(corpus_pipeline.quality_stage(spark, docs, sf_dir))
    scored = quality.quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("predicted = 1")
    assert sorted((r[0] for r in kept), key=str) == sorted((r.doc_id for r in scored.collect()), key=str)
    got = {r[0] for r in kept}
    assert len(got & set(range(60))) >= 58 and len(got & set(range(60, 120))) <= 2
    given = set(rows_of(docs.select(*COLUMNS)))
    assert all(r in given for r in kept)


def test_line_stage(spark, sf_dir):
    docs = documents(spark, sf_dir).filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    given = rows_of(docs.select("doc_id", "text"))
    left = {}
    whole = [(i, t) for i, t in given if t is not None]
    for (i, _), (text, gone) in zip(whole, deduplicated([t for _, t in whole]), strict=True):
        if not gone or re.search(r"[^\t\r\n ]", text):
            left[i] = text
    left |= {i: None for i, t in given if t is None}
    got = corpus_pipeline.line_stage(spark, docs, sf_dir)
    assert got.columns == COLUMNS
    assert {r[0]: r[1] for r in rows_of(got)} == left
    assert all(r[4] == (len(r[1]) if r[1] is not None else None) for r in rows_of(got))


def test_near_duplicate_stage(spark, sf_dir):
    docs = documents(spark, sf_dir)
    want = [i for i, (_, c) in components(dict(enumerate(texts()))).items() if i == c]
    got = [r[0] for r in rows_of(corpus_pipeline.near_duplicate_stage(spark, docs, sf_dir))]
    assert got == [None, *want]


def test_decontamination_stage(spark, sf_dir):
    docs = documents(spark, sf_dir)
    bad = {i for i, r in contaminated(texts(), {1: ITEM, 2: None}).items() if r[4]}
    assert len(bad) == 1
    got = rows_of(corpus_pipeline.decontamination_stage(spark, docs, sf_dir))
    assert got == [r for r in rows_of(docs.select(*COLUMNS)) if r[0] not in bad]


def check_packing(given: list[tuple], rows: list) -> None:
    """All pieces of all (doc_id, text), each sequence without a gap and full at most."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for doc_id, text in given:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want.append((doc_id, k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 4096


def test_packing_stage(spark, sf_dir):
    docs = documents(spark, sf_dir)
    check_packing([(r[0], r[1]) for r in rows_of(docs.select(*COLUMNS))], corpus_pipeline.packing_stage(spark, docs, sf_dir).collect())


def test_run_is_its_stages_one_after_another(spark, sf_dir, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"
    ]
    docs = documents(spark, sf_dir)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        assert docs.columns == COLUMNS
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    check_packing([(r[0], r[1]) for r in rows_of(docs)], packed)


def test_stages_on_an_empty_table(spark, sf_dir):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.read.parquet(f"{sf_dir}/empty.parquet"), sf_dir).count() == 0
