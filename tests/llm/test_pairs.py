"""Operators 3, 4, 5 and 9 against brute force, and on odd inputs."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from helpers import CLASHES, DOCS, ODD, WORDS, components, frame, lower
from pyspark.sql import functions as F

from graphloom.llm import decontamination, exact_dedup, line_dedup, ngram_join, quality, toxicity


def copies(seed: int, groups: int, size: int, words: int, edits: int) -> list[str]:
    """Groups of near copies of random texts, with a passage that half of all texts share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    passage, out = " ".join(word() for _ in range(30)), []
    for _ in range(groups):
        base = [word() for _ in range(words)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, edits)):
                copy[rng.randrange(words)] = word()
            out.append(" ".join(copy) + (" " + passage if rng.random() < 0.5 else ""))
    return out


@pytest.mark.parametrize(("groups", "size", "words", "edits"), [(25, 4, 60, 3), (2, 150, 90, 4), (40, 2, 7, 1)])
def test_join_equals_brute_force(spark, groups, size, words, edits, monkeypatch):
    monkeypatch.setattr(ngram_join, "STAR_ABOVE", 16)
    monkeypatch.setattr(ngram_join, "BLOCK", 40)
    texts = copies(groups, groups, size, words, edits)
    members, _, links = ngram_join.similar_documents(frame(spark, texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in members.collect()}
    assert got == components(dict(enumerate(texts)))
    assert all(100 * r.common >= 80 * r.together for r in links.collect())


def test_join_on_odd_inputs(spark):
    docs = frame(spark, ODD, extra=True)
    members, _, _ = ngram_join.similar_documents(docs)
    rows = members.collect()
    assert len(rows) == docs.count()
    want = components(dict(enumerate(ODD)))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None} == want
    kept = ngram_join.one_of_each(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [i for i, (_, c) in want.items() if i == c] and ids.count(None) == 1
    assert ngram_join.similar_documents(spark.createDataFrame([], DOCS))[0].count() == 0


def test_repeated_lines_go_but_the_first(spark):
    a, b = "l1\nl2\nl3\nl4\nown a", "own b\nl2\nl3\nl4\nl1"
    docs = frame(spark, [a, b, "l1\nl2", None, "", "\n\n\n\n\n", "\n\n\n\n\n"], extra=True)
    rows = line_dedup.drop_repeated_lines(docs).collect()
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in rows}
    assert len(rows) == 9
    assert got[0] == (a, 5, 0) and got[1] == ("own b\nl1", 5, 3) and got[2] == ("l1\nl2", 2, 0)
    assert got[3] == (None, 0, 0) and got[4] == ("", 1, 0) and got[6] == ("\n\n\n\n\n", 6, 0)
    assert {"row", "label", "class"} <= set(rows[0].asDict())
    assert line_dedup.drop_repeated_lines(spark.createDataFrame([], DOCS)).count() == 0


def deduplicated(texts: list[str], size: int = 3) -> list[tuple[str, int]]:
    """(text left, lines removed), window by window; a text of fewer lines is one window."""
    seen, out = set(), []
    for text in texts:
        lines, gone = text.split("\n"), set()
        for i in range(max(1, len(lines) - size + 1)):
            window = tuple(lines[i : i + size])
            if any(x.strip("\t\r ") for x in window):
                gone |= set(range(i, i + len(window))) if window in seen else set()
                seen.add(window)
        out.append(("\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone)))
    return out


def test_texts_of_one_or_two_lines_are_windows_too(spark):
    rng = random.Random(3)
    passage = " ".join(f"w{i}" for i in range(60))
    texts = [passage, passage, f"{passage}\nb", f"{passage}\nb", f"b\n{passage}", "", "", " \n", " \n", f"{passage}\nb\nc", passage]
    texts += ["\n".join(rng.choice("ab ") for _ in range(rng.randint(1, 6))) for _ in range(80)]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.drop_repeated_lines(frame(spark, texts)).collect()}
    assert got == dict(enumerate(deduplicated(texts)))
    assert got[1] == ("", 1) and got[3] == ("", 2) and got[10] == ("", 1)


def test_a_long_text_of_one_line_over_and_over(spark):
    text = "\n".join(["again"] * 20_000)
    (row,) = line_dedup.drop_repeated_lines(frame(spark, [text])).collect()
    assert (row.text, row.n_removed) == ("again", 19_999)


def contaminated(texts: list, items: dict) -> dict:
    windows = defaultdict(set)
    for name, text in items.items():
        words = WORDS.findall(lower(text))
        for i in range(max(1, len(words) - 12)) if words else ():
            windows[tuple(words[i : i + 13])].add(name)
    out = {}
    for doc_id, text in enumerate(texts):
        words, hit, found = WORDS.findall(lower(text)), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                if names := windows.get(tuple(words[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= names
        digest = hashlib.sha256(",".join(sorted(str(f) for f in found)).encode()).hexdigest()
        out[doc_id] = (len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words))
    return out


@pytest.mark.parametrize("block_bytes", [decontamination.BLOCK_BYTES, 200])
def test_decontamination_equals_brute_force(spark, block_bytes):
    rng = random.Random(4)
    word = lambda: rng.choice(["the", "of", "a", "Ü", "x9", "b", "cc"]) if rng.random() < 0.7 else str(rng.random())
    items = {i: " ".join(word() for _ in range(rng.choice([3, 12, 13, 14, 40]))) for i in range(12)} | {90: "", 91: None, 92: "Solo"}
    texts = [*ODD, "solo", " ".join(["of"] * 50)]
    for _ in range(40):
        parts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(3)]
        parts.insert(1, (items[rng.randrange(12)].upper() if rng.random() < 0.6 else ""))
        texts.append("; ".join(parts))
    docs, bench = frame(spark, texts), spark.createDataFrame(list(items.items()), "item_id long, text string")
    rows = decontamination.contamination(docs, bench, block_bytes=block_bytes).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows}
    assert got == contaminated(texts, items)
    assert decontamination.contamination(frame(spark, ODD, extra=True), bench).count() == len(ODD) + 2
    assert decontamination.contamination(spark.createDataFrame([], DOCS), bench).count() == 0
    assert decontamination.contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_proximity_matches(spark):
    docs = frame(spark, ["red x x green x blue", "red " + "x " * 30 + "green blue", "red green"])
    index = decontamination.build_index(docs)
    found = decontamination.search(index, [("i", [b"red", b"green", b"blue"])], near=6).collect()
    assert {(r.doc_id, r.kind) for r in found} == {(0, "near")}


def test_proximity_does_not_depend_on_segments(spark):
    texts = ["red x x green x blue the the the", "the the red green blue", "red " + "x " * 30 + "green blue", "the blue blue blue"]
    docs = frame(spark, texts).coalesce(1)
    items = spark.createDataFrame([("i", "the red green blue absent"), ("j", "red unseen unknown")], "item_id string, text string")
    for segment_bytes in (1, 60, 8_000_000):  # a document a segment, then some, then all
        for block_bytes in (decontamination.BLOCK_BYTES, 20):
            rows = decontamination.contamination(docs, items, near=6, near_terms=3, segment_bytes=segment_bytes, block_bytes=block_bytes).collect()
            assert {(r.doc_id, tuple(r.near_items), r.n_near, r.n_hit) for r in rows} == {(0, ("i",), 1, 0), (1, ("i",), 1, 0), (2, (), 0, 0), (3, (), 0, 0)}
    # The second document's segment lacks a frequent word of the item.
    index = decontamination.build_index(docs, segment_bytes=1)
    found = decontamination.search(index, [("i", [b"red", b"green", b"blue", b"x"])], near=6).collect()
    assert {r.doc_id for r in found if r.kind == "near"} == {0, 1}


def test_exact_dedup(spark):
    docs = frame(spark, ODD, extra=True)
    rows = exact_dedup.exact_duplicates(docs).collect()
    assert len(rows) == len(ODD) + 2
    by = defaultdict(list)
    for r in rows:
        by[r.text_sha256].append(r)
    texts = [t or "" for t in ODD] + ["a text without an id", ODD[0]]
    assert {k: len(v) for k, v in by.items()} == {
        hashlib.sha256(t.encode()).hexdigest(): texts.count(t) for t in texts
    }
    for group in by.values():
        ids = [r.doc_id for r in group if r.doc_id is not None]
        assert {r.keep_id for r in group} == {max(ids) if ids else None}
        assert sum(r.kept for r in group) == 1 and {r.group_size for r in group} == {len(group)}
    assert exact_dedup.exact_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_chunks_join_to_the_text(spark):
    docs = frame(spark, [t for t in ODD if t])
    cut = docs.select("text", F.array_join(F.split("text", exact_dedup.CUT, -1), "").alias("again"))
    assert cut.filter("text <> again").count() == 0


def test_long_texts_of_any_script_are_cut(spark):
    sentences = {"cjk": "這是一個句子，不太長。", "cyrillic": "Это короткое предложение. ", "capitals": "A SHORT SENTENCE, IN CAPITALS. ", "digits": "1234, 5678. ", "french": "Une phrase coupée, été. ", "german": "Ein kurzer Satz, gut. "}
    docs = frame(spark, [s * 20_000 for s in sentences.values()])
    for r in docs.select(F.size(F.split("text", exact_dedup.CUT, -1)).alias("n")).collect():
        assert r.n >= 20_000
    many = frame(spark, [sentences["cjk"] * 150_000, sentences["cjk"] * 150_000, sentences["cjk"] * 149_999, "x" * 3_000_000, "x" * 3_000_000])
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(many).collect()}
    assert got == {0: (1, 2), 1: (1, 2), 2: (2, 1), 3: (4, 2), 4: (4, 2)}



def test_identifiers_that_several_chunks_share(spark):
    """With hashes of three values only, the chunks' bytes tell texts apart."""
    rng = random.Random(8)
    texts = ["".join(rng.choice(["ab. ", "cd! ", "x\n", "ey"]) for _ in range(rng.randint(0, 4))) for _ in range(120)]
    docs = frame(spark, texts)
    weak = lambda c: F.pmod(F.xxhash64(c), F.lit(3))
    assert exact_dedup.shared_identifiers(docs, name=weak).count() == 3 and exact_dedup.shared_identifiers(docs).count() == 0
    want = {i: (max(k for k, t in enumerate(texts) if t == texts[i]), texts.count(texts[i])) for i in range(len(texts))}
    for name in (weak, exact_dedup.hash64):
        assert {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(docs, name=name).collect()} == want


def clashing(docs):
    """``docs`` with columns of the names that operators use inside, in upper case too."""
    return docs.select("*", *[F.lit("own").alias(c) for c in CLASHES])


def test_columns_of_any_name_stay_as_they_are(spark):
    docs = clashing(frame(spark, ["a b c d e f\nx\ny", "a b c d e f\nx\ny", "other", None, ""]))
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    results = [
        line_dedup.drop_repeated_lines(docs), ngram_join.one_of_each(docs), decontamination.clean_documents(docs, items),
        quality.with_scores(docs, quality.fit([])), toxicity.with_scores(docs, toxicity.fit([])),
    ]
    for result, n in zip(results, (5, 4, 3, 5, 5), strict=True):
        rows = result.collect()
        assert len(rows) == n and all(r[c] == "own" for r in rows for c in CLASHES)
    for result in (ngram_join.similar_documents(docs)[0], decontamination.contamination(docs, items), exact_dedup.exact_duplicates(docs)):
        assert result.count() == 5


def test_clean_documents(spark):
    passage = " ".join(f"w{i}" for i in range(13))
    texts = [passage, passage + " x" * 300, passage + " x" * 200, None, "", "clean", "y" * 3_000_000, "many words " * 200_000]
    items = spark.createDataFrame([(1, passage.upper()), (2, None)], "item_id long, text string")
    kept = decontamination.clean_documents(frame(spark, texts, extra=True), items)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 4, 5, 6, 7]
    assert decontamination.clean_documents(frame(spark, texts), items.limit(0)).count() == len(texts)
    assert decontamination.clean_documents(spark.createDataFrame([], DOCS), items).count() == 0
