"""Sources with faults that the supplied tables do not have, against Python's own parsers and by hand."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import literals, text
from graphloom.operators import chunking, governed, similarity
from graphloom.sources import parsing, structured


def nested(rng: random.Random, depth: int = 0):
    kind = rng.randrange(6 if depth < 4 else 4)
    if kind < 4:
        return [rng.randint(-9, 99), rng.random() < 0.5, None, rng.choice(["a", 'q"\\/é', "", "{[,:]}"])][kind]
    if kind == 4:
        return [nested(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["k", "a/b", "~", "0", "é"]) + str(i): nested(rng, depth + 1) for i in range(rng.randrange(4))}


def test_json_nodes_stand_where_they_say():
    rng = random.Random(1)
    for _ in range(300):
        value = nested(rng)
        source = json.dumps(value, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        nodes = list(structured.json_nodes(source))
        for node in nodes:
            at = value
            for step in node.pointer.split("/")[1:]:
                name = step.replace("~1", "/").replace("~0", "~")
                at = at[int(name)] if isinstance(at, list) else at[name]
            assert json.loads(source[node.start : node.end]) == at
        count = lambda v: 1 + sum(map(count, v.values() if isinstance(v, dict) else v)) if isinstance(v, (dict, list)) else 1
        assert len(nodes) == count(value) == len({n.pointer for n in nodes})
    with pytest.raises(ValueError, match="DUPLICATE"):
        list(structured.json_nodes('{"a": 1, "\\u0061": 2}'))


def test_record_collections_leave_out_lists_in_records(spark):
    docs = [
        (1, '{"a": [{"x": [{"y": 1}]}, {"x": 2}], "b": [1, {"c": 1}], "d": {"e": [{}]}, "f": []}'), (2, '[{"k": 1}, {"k": 2}]'), (3, "[1]"),
        (4, "not json"), (5, json.dumps({f"c{i}": [{}] for i in range(17)})), (6, json.dumps([{}] * 2001)), (7, None),
    ]
    nodes = structured.locate_json(spark.createDataFrame(docs, "doc_id long, text string"))
    got = {(r.doc_id, r.collection, r.record, r.problem) for r in structured.record_collections(nodes).collect()}
    assert got == {
        (1, "/a", 0, None), (1, "/a", 1, None), (1, "/d/e", 0, None), (2, "", 0, None), (2, "", 1, None),
        (5, None, None, "MAPPING_SOURCE_LIMIT"), (6, None, None, "MAPPING_SOURCE_LIMIT"),
    }
    assert {r.doc_id for r in nodes.filter("kind = 'error'").collect()} == {4, 7}


def test_markdown_faults_and_cells():
    table = "## [A] one\n| x | y |\n|:---|---:|\n| 1 | `a|b` \\| |\n"
    problem, rows = structured.markdown_records("intro\n" + table + "```\n## no\n| a |\n```\n## two ##\n", 2)
    assert problem is None
    assert [(r[0], r[1]) for r in rows if r[2] is None] == [("A", "one"), ("two", "two")]
    assert [r[2:6] for r in rows if r[2] is not None] == [(0, 0, "x", "1"), (0, 0, "y", "`a|b` \\|")]
    for source, code in (
        ("none", "MARKDOWN_SECTION_LIMIT"), ("## a\n### b\n", "MARKDOWN_UNMAPPED_HEADING_LEVEL"), ("## a\n## a\n", "MARKDOWN_DUPLICATE_SECTION"),
        ("## a\n```\n", "MARKDOWN_FENCE_UNCLOSED"), ("## a\n| x |\n", "MARKDOWN_TABLE_INVALID"), ("## a\n| x | x |\n|---|---|\n", "MARKDOWN_TABLE_HEADER"),
        ("## a\n| x |\n|---|\n| 1 | 2 |\n", "MARKDOWN_TABLE_WIDTH"),
    ):
        assert structured.markdown_records(source, 2) == (code, [])


def test_every_split_is_gapless_and_bounded(spark):
    rng = random.Random(2)
    pieces = ["# h\n", "## [x] y\n", "text text. ", "\n\n", "```\ncode # no\n```\n", "~~~\n", "| a | b |\n|---|---|\n| 1 | 2 |\n", "<a b='>'>", "</a>", "<!-- <x> -->", "ü" * 40]
    docs = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 60)))) for i in range(60)] + [(60, None), (61, "y" * 5000), (62, "")]
    jsons = [(i, json.dumps([nested(rng) for _ in range(rng.randint(1, 30))])) for i in range(40)]
    for rows, split in (
        (docs, chunking.split_boundary), (docs, chunking.split_markdown_sections), (docs, chunking.split_markdown_packed), (docs, chunking.split_xml), (jsons, chunking.split_json),
    ):
        texts = dict(rows)
        found: dict = {}
        for r in split(spark.createDataFrame(rows, "doc_id long, text string"), 100).collect():
            assert r.chunk == texts[r.doc_id][r.char_start : r.char_end] and 0 < len(r.chunk) <= 100
            found.setdefault(r.doc_id, []).append((r.ordinal, r.char_start, r.char_end))
        for key, source in texts.items():
            chunks = sorted(found.get(key, []))
            ends = [0, *(e for _, _, e in chunks)]
            assert [o for o, _, _ in chunks] == list(range(len(chunks))) and [s for _, s, _ in chunks] == ends[:-1] and ends[-1] == len(source or "")


def test_parsing_limits(spark):
    limits = parsing.Limits(source_bytes=100, chars=20)
    rows = [
        (1, b"", "text/plain", "EMPTY"), (2, b"a" * 101, "text/plain", "BYTE_LIMIT"), (3, b"a" * 21, "text/plain", "CHARACTER_LIMIT"), (4, b"a", "text/plain;charset=utf-16", "CHARSET_UNSUPPORTED"),
        (5, b"a", "text/html", "MEDIA_UNSUPPORTED"), (6, "é".encode(), "text/plain", None), (7, b"\xef\xbb\xbfa\r\nb\rc", "TEXT/Markdown ; charset=\"utf-8\"", None), (8, None, "text/plain", "EMPTY"),
        (9, b"a\x00b", "text/plain", "CONTROL_CHARACTER"), (10, " ".encode(), "text/plain", "BLANK"), (11, b'{"a":1,"a":1}', "application/json", "JSON_DUPLICATE_KEY"),
        (12, b"<a><b></a>", "text/xml", "XML_INVALID"), (13, b"a,\"b\nc\",d", "text/csv", None), (14, b'a,"b"c', "text/csv", "CSV_INVALID"), (15, b"x", None, "CHARSET_UNSUPPORTED"),
    ]
    sources = spark.createDataFrame([r[:3] for r in rows], "id int, payload binary, mime_type string")
    got = {r.id: (r.problem, r.text) for r in parsing.parse_sources(sources, limits).collect()}
    assert {k: p for k, (p, _) in got.items()} == {r[0]: r[3] for r in rows}
    assert got[6][1] == "é" and got[7][1] == "a\nb\nc" and got[13][1] == 'a,"b\nc",d' and got[1][1] is None
    for bad in ({"max_chars": 799}, {"max_chars": 3001}, {"max_chars": True}, {"strategy": "other"}):
        with pytest.raises(ValueError, match="max_chars|strategy"):
            chunking.ChunkingOptions(**bad)
    assert chunking.ChunkingOptions(60_000, "mapped_document").signature.endswith("mapped_document:max=60000")


def test_literals_and_redaction(spark):
    cases = [
        ("INTEGER", "007", None), ("INTEGER", "-0", "0"), ("INTEGER", "7 ", None), ("DECIMAL", "1e3", "1000"), ("DECIMAL", "-1.500", "-1.5"), ("FLOAT", "2.5E-3", "0.0025"), ("FLOAT", ".5", None),
        ("BOOLEAN", "TRUE", "true"), ("DATE", "2024-02-30", None), ("DATETIME", "2024-01-01T00:30:00.5+01:00", "2023-12-31T23:30:00.500000Z"), ("DATETIME", "2024-01-01T00:00:00", None),
        ("DURATION", "PT", None), ("DURATION", "P1Y2M3DT4H5M6.7S", "P1Y2M3DT4H5M6.7S"), ("URI", "urn:x", "urn:x"), ("URI", "x y:z", None), ("JSON", '{"b":1, "a":[1.0]}', '{"a":[1.0],"b":1}'),
        ("JSON", '{"a":1,"a":2}', None), ("STRING", "é", "é"), ("STRING", "", None), ("OTHER", "x", None),
    ]
    rows = spark.createDataFrame([(i, d, r) for i, (d, r, _) in enumerate(cases)], "i int, d string, r string")
    got = {r.i: r.c for r in rows.select("i", literals.canonical(F.col("r"), F.col("d")).alias("c")).collect()}
    assert [got[i] for i in range(len(cases))] == [c for _, _, c in cases]
    long = spark.createDataFrame([("token: abc " + "x" * 50,)], "t string").select(text.redact(F.col("t"), 30).alias("r")).first().r
    assert long == "token: [REDACTED] xxxxxxxxxxxx[TRUNCATED]"


def test_preflight_and_near_pairs_by_all_pairs(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(40, 90))) for _ in range(12)]
    texts = [b if rng.random() < 0.2 else b[:k] + rng.choice("xyz") + b[k:] for b in base for k in (3, 20, 30, 35)] + ["", None, "abc", "abcd"]
    sets = [{(t or "")[i : i + 5] for i in range(max(1, len(t or "") - 4))} if t else set() for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first = {t or "": i for i, t in reversed(list(enumerate(texts)))}
    want = {
        (a, b): (len(sets[a] & sets[b]), len(sets[a] | sets[b]))
        for a in first.values() for b in first.values() if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    }
    odd = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, texts[0]), (None, "new")], "doc_id long, text string"))
    for rows in (docs, docs.repartition(7), odd.withColumn("id", F.lit("x")).withColumn("sum", F.lit(1))):
        got = {(r.a, r.b): (r.common, r.together) for r in similarity.near_pairs(rows).collect()}
        assert got == want and len(want) > 10
    assert similarity.near_pairs(docs.limit(0)).count() == 0 and similarity.preflight(docs.limit(0).withColumnRenamed("doc_id", "upload_id"), docs).count() == 0
    found = {(r.upload_id, r.doc_id, r.kind) for r in similarity.preflight(docs.filter("doc_id < 8").withColumnRenamed("doc_id", "upload_id"), docs).collect()}
    expected = set()
    for u in range(8):
        for d, t in enumerate(texts):
            if (t or "") == (texts[u] or ""):
                expected.add((u, d, "EXACT"))
            elif 0.8 * len(texts[u]) <= len(t or "") <= 1.25 * len(texts[u]) and sets[d] and 100 * len(sets[u] & sets[d]) >= 85 * len(sets[u] | sets[d]):
                expected.add((u, d, "SIMILAR"))
    assert found == expected


def test_windows_and_pages(spark):
    rows = spark.createDataFrame([(1, "the Cat sat"), (2, "concat " * 30 + "a cat " + "z" * 300), (3, "é" * 300), (4, None)], "id int, t string")
    cut = {r.id: (r.w, r.b) for r in rows.select("id", governed.window_start(F.col("t"), ["cat"], F.lit(20)).alias("w"), governed.byte_bounded_window(F.col("t"), ["cat"], 31).alias("b")).collect()}
    assert cut[1] == (0, "the Cat sat") and cut[2][0] == 212 - 8 and "a cat z" in cut[2][1] and len(cut[2][1]) == 31 and cut[3][1] == "é" * 15 and cut[4][1] is None
    edges = spark.createDataFrame([(f"e{i:03}", "hub", f"n{i:03}") for i in range(250)], "key string, source string, target string")
    depths = spark.createDataFrame([("hub", 0)] + [(f"n{i:03}", 1) for i in range(250)], "node string, depth int")
    none = spark.createDataFrame([], "key string, node string")
    page = governed.graph_page(edges, none, depths.select("node"), depths, 240).collect()
    # 199 neighbours and the hub are as many nodes as a page may hold.
    assert len(page) == 199 and all(r.has_more and r.kind == "relationship" for r in page)
    assert [r.has_more for r in governed.graph_page(edges.limit(3), none, depths.limit(1).select("node"), depths.limit(1), 10).collect()] == [False] * 4


def _of_one_vocabulary(n, least, most):
    """Texts of few different words, of sizes around where signatures change, and near copies of some."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 9))) for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(least, most))) for _ in range(n)]
    return texts + [t[: len(t) // 2] + extra + t[len(t) // 2 :] for t in texts[::4] for extra in ("", " new words ", "x" * 90)][1:]


def test_texts_of_one_vocabulary_are_no_candidates(spark, monkeypatch):
    # Rare shingles are shared by most such texts, so by prefixes nearly all pairs of a size were candidates, stored and joined with their sets.
    texts = _of_one_vocabulary(120, 350, 420)
    seen, plain = {}, similarity.stage

    def counted(rows, label):
        out = plain(rows, label)
        seen[label] = seen.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(similarity, "stage", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = similarity.near_pairs(docs).count()
    assert 30 <= found <= seen["candidates"] <= 1.5 * found
    seen.clear()
    assert similarity.preflight(docs.filter("doc_id % 10 = 0").withColumnRenamed("doc_id", "upload_id"), docs).count() > 10
    assert seen["candidates"] <= 60


def test_near_pairs_around_signature_sizes(spark, monkeypatch):
    texts = _of_one_vocabulary(60, 50, 200)  # 300 to 1200 shingles: levels and their guests
    monkeypatch.setattr(similarity, "GROUP_ROWS", 7)
    monkeypatch.setattr(similarity, "PAIRS_AT_ONCE", 5)
    sets = [{t[i : i + 5] for i in range(len(t) - 4)} for t in texts]
    want = {(a, b, len(x & y), len(x | y)) for b, y in enumerate(sets) for a, x in enumerate(sets[:b]) if texts[a] != texts[b] and 100 * len(x & y) >= 85 * len(x | y)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    twins = {b: a for b, t in enumerate(texts) for a in (texts.index(t),) if a < b}
    want = {w for w in want if w[0] not in twins and w[1] not in twins}
    assert {tuple(r) for r in similarity.near_pairs(docs).collect()} == want
    levels = {max(similarity.LEAST_LEVEL, len(sets[i]).bit_length() - 1) for w in want for i in w[:2]}
    assert levels == {8, 9, 10} and any(len({len(sets[i]).bit_length() for i in w[:2]}) > 1 for w in want)
