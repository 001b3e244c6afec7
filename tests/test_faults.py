"""Cases that earlier versions got wrong."""

from __future__ import annotations

import math
import random
import re
import threading
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom import staging, store
from graphloom.functions import literals
from graphloom.functions.text import REDACTIONS, redact
from graphloom.operators import fulltext, lifecycle, quality_audit
from graphloom.sources import structured


def python_redacted(text: str) -> str:
    text = re.sub(r"[\x00-\x1f\x7f-\x9f]", " ", text)
    for pattern, by in REDACTIONS:
        text = re.sub(pattern, re.sub(r"\$(\d)", r"\\\1", by), text)
    return text


BLANKS = (" ", "\u00A0", "\u3000", "\u2003", "\u1680", "\t", "\u0085", "\u202F")


def test_patterns_see_blanks_and_letters_of_unicode(spark):
    texts = [t.replace("_", b) for b in BLANKS for t in (
        "Bearer_abcd1234efgh x", "password_=_hunter2_next", "token:abc_def", "https://bob:pw_x@host/y", "https://bob:pw@host/x", "ftp://alice_b@host",
        "_sk-ABCDEFGH12345678_", "GET /a?api_key=12_345", "eyJhbGci.eyJzdWIi.c2lnbmF0dXJl_end", "-----BEGIN RSA PRIVATE KEY-----_MIIB_-----END RSA PRIVATE KEY----- rest",
    )] + ["éBearer abcd1234", "paſſword=abc", "basıc QWxhZGRpbjpv", "toKen=abc", "", "nothing"]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(len(texts), None)], "id int, text string")
    got = {r.id: r.out for r in rows.select("id", redact(F.col("text")).alias("out")).collect()}
    assert got == {i: python_redacted(t) for i, t in enumerate(texts)} | {len(texts): None}
    assert "abcd1234efgh" not in got[0]


def test_a_replay_stands_in_no_writes_way(spark):
    store_ = spark.createDataFrame([("r", 3, "now"), ("r", 2, "old"), ("s", 1, "a"), ("n", 1, None)], "record_id string, revision int, content string")
    writes = [("r", 3, "now"), ("r", 3, "zz"), ("r", 3, "zzz"), ("r", 2, "yy"), ("s", 9, "a"), ("t", None, "first"), ("t", None, "second"), ("t", None, "first"),
              ("u", 1, "x"), ("n", 1, None), ("n", 1, "v"), (None, None, "w")]
    after, done = lifecycle.save(store_, spark.createDataFrame(writes, "record_id string, expected_revision int, content string"))
    got = {(r.record_id, r.expected_revision, r.content): (r.outcome, r.revision) for r in done.collect()}
    assert got == {
        ("r", 3, "now"): ("REPLAYED", 3), ("r", 3, "zz"): ("STORED", 4), ("r", 3, "zzz"): ("REVISION_CONFLICT", None), ("r", 2, "yy"): ("REVISION_CONFLICT", None),
        ("s", 9, "a"): ("REPLAYED", 1), ("t", None, "first"): ("STORED", 1), ("t", None, "second"): ("REVISION_CONFLICT", None),
        ("u", 1, "x"): ("REVISION_CONFLICT", None), ("n", 1, None): ("REPLAYED", 1), ("n", 1, "v"): ("STORED", 2), (None, None, "w"): ("REVISION_CONFLICT", None),
    }
    assert after.count() == 7


def decimal_text(token: str) -> str:
    value = Decimal(token)
    if value == 0:
        return "0"
    text = format(value, "f")
    return (text.rstrip("0").rstrip(".") if "." in text else text).removeprefix("+")


def test_numbers_keep_all_their_digits(spark):
    rng = random.Random(2)
    tokens = ["1e-19", "1e40", "-0", "-0.000e7", "0e999", "+5", "1.50", "123456789012345678901234567890.1234567890123456789", "1e308", "-2.5E-300", "7E+0", "100", "0.10e1", "10e-1"]
    tokens += [f"{rng.choice(['', '-', '+'])}{rng.choice(['0', str(rng.randint(1, 10**rng.randint(1, 30)))])}"
               + rng.choice(["", f".{rng.randint(0, 10**12)}"]) + rng.choice(["", f"e{rng.randint(-60, 60)}", f"E+{rng.randint(0, 40)}"]) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(tokens)), "id int, raw string")
    for r in rows.select("id", literals.number_text(F.col("raw")).alias("out")).collect():
        assert r.out == decimal_text(tokens[r.id]), tokens[r.id]
    some = spark.createDataFrame([("1e400",), ("1e-400",), ("1e10001",), ("12",), (None,), ("x",), ("1e99999999999",)], "raw string")
    floats = {r.raw: r.out for r in some.select("raw", literals.canonical(F.col("raw"), F.lit("FLOAT")).alias("out")).collect()}
    assert floats == {"1e400": None, "1e-400": "0." + "0" * 399 + "1", "1e10001": None, "12": "12", None: None, "x": None, "1e99999999999": None}
    big = {r.raw: r.out for r in some.select("raw", literals.canonical(F.col("raw"), F.lit("DECIMAL")).alias("out")).collect()}
    assert big["1e400"] == "1" + "0" * 400 and big["1e10001"] is None and math.isinf(float("1e400"))


def test_diamonds_have_a_row_for_each_depth(spark):
    edges = [e for k in range(40) for e in ((f"l{k}", f"t{k}"), (f"r{k}", f"t{k}"), (f"t{k + 1}", f"l{k}"), (f"t{k + 1}", f"r{k}"))][: 4 * 8]
    found = quality_audit.hierarchy(spark.createDataFrame(edges, "child string, parent string"), spark).collect()
    assert len(found) == 25 and {(r.node, r.depth) for r in found} == {(f"{c}{k}", 2 * k + (c != "t")) for k in range(8) for c in "lrt"} | {("t8", 16)}
    uneven = [("a", "root"), ("b", "a"), ("b", "root"), (None, "root"), ("c", None)]
    rows = quality_audit.hierarchy(spark.createDataFrame(uneven, "child string, parent string"), spark).collect()
    assert sorted((r.node, r.depth) for r in rows) == [("a", 1), ("b", 1), ("b", 2), ("root", 0)]


@pytest.mark.parametrize(("text", "problem", "sections"), [
    ("   ## one\ntext\n ## two\n", None, [("one", "one"), ("two", "two")]),
    ("    ## code\n## one\n", None, [("one", "one")]),
    ("## [a]\n## [b] Title\n## [c]Title\n## [d[e] x\n", None, [("[a]", "[a]"), ("b", "Title"), ("[c]Title", "[c]Title"), ("d[e", "x")]),
    ("## one\n| a |\n|-|\n| 1 |\n", "MARKDOWN_TABLE_INVALID", []),
    ("## one\n| a |\n|:-:|\n", "MARKDOWN_TABLE_INVALID", []),
    ("## one\n| a |\n|:---|\n| 1 |\n", None, [("one", "one")]),
    ("## one\n   ### deeper\n", "MARKDOWN_UNMAPPED_HEADING_LEVEL", []),
])
def test_headings_and_tables_of_markdown(text, problem, sections):
    found, rows = structured.markdown_records(text, 2)
    assert found == problem and [r[:2] for r in rows if r[2] is None] == sections


def test_the_index_follows_its_table_and_outlives_release(spark, tmp_path):
    path = f"{tmp_path}/documents"
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    docs([(1, "Alpha beta beta"), (2, None), (3, "")]).write.parquet(path)
    table = lambda: spark.read.parquet(path)
    search = lambda: {r.id for r in fulltext.bm25(fulltext.index_of(table(), "t", root=str(tmp_path)), ["alpha"]).collect()}
    assert search() == {1}
    rows = {(r.term, r.id, r.tf, r.length) for r in fulltext.index_of(table(), "t", root=str(tmp_path)).collect()}
    assert rows == {("", 1, 1, 3), ("", 2, 1, 0), ("", 3, 1, 0), ("alpha", 1, 1, 3), ("beta", 1, 2, 3)}
    docs([(4, "alpha"), (5, "gamma ALPHA")]).write.mode("append").parquet(path)
    assert search() == {1, 4, 5}
    staging.release()
    assert search() == {1, 4, 5}
    folder = next((tmp_path / "graphloom-fulltext").iterdir())
    assert len(list(folder.glob("*.at"))) == 2
    (folder / "unfinished").mkdir()
    assert fulltext.drop_indexes(table(), "t", root=str(tmp_path)) == 1
    assert len(list(folder.glob("*.at"))) == 1 and not (folder / "unfinished").exists() and search() == {1, 4, 5}


def test_an_unfinished_index_is_never_read(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "alpha")], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    monkeypatch.setattr(store, "publish_new", lambda *_: (_ for _ in ()).throw(OSError("lost before publishing")))
    with pytest.raises(OSError, match="lost"):
        fulltext.index_of(docs, "t", root=str(tmp_path))
    monkeypatch.undo()
    assert fulltext.index_of(docs, "t", root=str(tmp_path)).count() == 2


def test_of_many_writers_one_publishes(spark, tmp_path):
    won: list[int] = []
    path = f"file://{tmp_path}/deep/pointer"

    def write(k: int) -> None:
        if store.publish_new(spark, path, f"writer {k}" * 1000):
            won.append(k)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(16)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and store.read_text(spark, path) == f"writer {won[0]}" * 1000
    assert store.names_in(spark, f"file://{tmp_path}/deep") == ["pointer"] and store.read_text(spark, f"{path}2") is None


def test_the_index_counts_words_in_slices(monkeypatch):
    # Memory of the Python workers grew with the texts of a batch of ten thousand documents.
    monkeypatch.setattr(fulltext, "WORDS_AT_ONCE", 50)
    bags = [["a", "b", "a"] * 10, None, [], ["c"] * 200, *[["d", "a"]] * 40]
    batch = pa.RecordBatch.from_arrays([pa.array([5, None, 7, 8, *range(40)], pa.int64()), pa.array([b or [] for b in bags], pa.list_(pa.string()))], names=["id", "bag"])
    parts = list(fulltext._counted(iter([batch.slice(0, 0), batch])))
    assert len(parts) >= 4 and max(len(p) for p in parts) <= 3 * 50
    got = sorted((r["id"] is None, r["id"] or 0, r["term"], r["tf"], r["length"]) for p in parts for r in p.to_pylist())
    want = [(k is None, k or 0, t, b.count(t) if t else 1, len(b)) for k, b in zip(batch["id"].to_pylist(), batch["bag"].to_pylist(), strict=True) for t in {"", *b}]
    assert got == sorted(want)
