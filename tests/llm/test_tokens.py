"""Operators 2, 7 and 10 against the tokenizers library, round trips and packing rules."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import DOCS, ODD, frame
from tokenizers import Tokenizer

from graphloom.llm import packing, token_counts, token_store
from graphloom.llm.pieces import PieceEncoder

FILES = {True: "byte_bpe_50k.json", False: "word_bpe_49k.json"}


#: Texts with a NUL, alone and before words.
NULS = ["a \0firstb c", "\0firstabc", "\0first", " \0 \0x", "\0"]


def library_ids(texts: list, name: str) -> list[list[int]]:
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("spaced", [True, False])
def test_pieces_encode_as_the_whole_text(spaced):
    rng = random.Random(1)
    letters = "aB é\n\t .,'s’!<|>endoftext12ß$ ́ 日İΣ\x1c\u0085"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    texts += [t or "" for t in ODD] + NULS + ["a1b2" * 3000, " lead  two\n \n x", "it's 'twas IT'S don't"]
    encoder = PieceEncoder(public_tokenizers.path(FILES[spaced]), spaced, most=500)
    want = library_ids(texts, FILES[spaced])
    at = 0
    for k in range(0, len(texts), 100):
        ids, counts = encoder.ids(texts[k : k + 100])
        ends = np.cumsum(counts)
        for a, b in zip(ends - counts, ends, strict=True):
            assert ids[a:b].tolist() == want[at], texts[at]
            at += 1
        assert encoder.lengths(texts[k : k + 100]).tolist() == counts.tolist()


def test_token_counts(spark):
    texts = ODD + NULS + ["spaceless" * 400_000, "many words " * 300_000]
    docs = frame(spark, texts, extra=True)
    rows = token_counts.token_counts(docs, public_tokenizers.path(FILES[True]), batch_bytes=1000).collect()
    want = [len(x) for x in library_ids(texts, FILES[True])]
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows}
    assert len(rows) == len(texts) + 2
    assert all(got[i] == (len((t or "").encode()), want[i], want[i] > 512) for i, t in enumerate(texts))
    assert token_counts.token_counts(spark.createDataFrame([], DOCS), public_tokenizers.path(FILES[True])).count() == 0


def test_store_round_trip(spark):
    texts = ODD + NULS + ["some more words here"] * 5
    docs = frame(spark, texts, extra=True)
    rows = token_store.store_and_read(docs, public_tokenizers.path(FILES[False]), 2).collect()
    ids = [[*x, 2] for x in library_ids([*texts, "a text without an id", texts[0]], FILES[False])]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    want, start = [], 0
    for doc_id, x in sorted(zip([*range(len(texts)), None, 0], ids, strict=True), key=lambda p: (p[0] is not None, p[0] or 0)):
        want.append((doc_id, start, len(x), crc(x)))
        start += len(x)
    assert sorted([tuple(r) for r in rows], key=lambda r: r[1]) == want
    assert token_store.store_and_read(docs.limit(0), public_tokenizers.path(FILES[False]), 2).count() == 0


def test_store_files_are_addressable(spark, tmp_path):
    docs, path = frame(spark, ODD), f"file://{tmp_path}/store"
    token_store.write_store(docs, path, public_tokenizers.path(FILES[False]), 2, per_range=4, ids_per_file=50)
    contents = [r.content for r in spark.read.format("binaryFile").load(path).collect()]
    assert len(contents) > 4
    want = {i: [*x, 2] for i, x in enumerate(library_ids(ODD, FILES[False]))}
    for content in contents:
        f = token_store.TokenFile(bytes(content))
        for k, doc_id in enumerate(map(f.doc_id, range(len(f.names)))):
            a, b = int(f.starts[k]), int(f.starts[k + 1])
            assert f.document(k).tolist() == want.pop(doc_id) if b - a > 3000 else [f.token(i) for i in range(a, b)] == want.pop(doc_id)
    assert not want
    rng = np.random.default_rng(0)
    values = rng.integers(0, 1 << 32, 5000).astype(np.uint32) >> rng.integers(0, 32, 5000).astype(np.uint32)
    f = token_store.TokenFile(token_store.encode_file([1], [5000], values, 0, 0) + token_store.END.encode())
    assert f.tokens(700, 4000).tolist() == values[700:4000].tolist() and f.token(4999) == values[4999]
    with pytest.raises(ValueError, match="cut short"):
        token_store.TokenFile(b"GLDAC\x01")


def check_plan(counts: dict[int, int], capacity: int) -> int:
    bins: dict[int, list] = {}
    for n, first, last, sequence, each, offset in packing.best_fit_plan(counts, capacity).tolist():
        for k in range(last - first):
            bins.setdefault(sequence + k // each, []).append((offset + k % each * n, n))
    placed: dict[int, int] = {}
    for pieces in bins.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
            placed[n] = placed.get(n, 0) + 1
        assert at <= capacity
        assert sum(3 * n > capacity for _, n in pieces) <= 2
    assert placed == counts
    return len(bins)


def test_plans_pack_everything_tightly():
    rng = random.Random(3)
    for _ in range(100):
        capacity = rng.choice([10, 50, 100, 4096])
        counts = {rng.randint(1, capacity): rng.randint(1, 60) for _ in range(rng.randint(1, 150))}
        bins = check_plan(counts, capacity)
        items = sorted((n for n, c in counts.items() for _ in range(c)), reverse=True)
        spare: list[int] = []  # best-fit decreasing, piece by piece
        for n in items:
            fits = [s for s in spare if s >= n]
            if fits:
                spare.remove(min(fits))
                spare.append(min(fits) - n)
            else:
                spare.append(capacity - n)
        assert bins <= len(spare) * 1.02 + 1
    assert packing.best_fit_plan({}, 10).shape == (0, 6)
    with pytest.raises(ValueError, match="capacity"):
        packing.best_fit_plan({11: 1}, 10)


def test_the_memo_is_bounded_in_characters(monkeypatch):
    monkeypatch.setattr("graphloom.llm.pieces.MEMO_CHARS", 10_000)
    encoder = PieceEncoder(public_tokenizers.path(FILES[True]), True)
    for k in range(40):
        encoder.lengths([f"{k}" + "x" * 3000])
    assert sum(len(p[0]) for p in encoder.known) < 20_000


@pytest.mark.parametrize("plan_rows", [packing.PLAN_ROWS, 3])
def test_packing(spark, plan_rows, monkeypatch):
    monkeypatch.setattr(packing, "PLAN_ROWS", plan_rows)
    texts = ODD + NULS + ["short one"] * 20
    docs = frame(spark, texts)
    rows = packing.pack_documents(docs, public_tokenizers.path(FILES[False]), 64).collect()
    ids = {i: [*x, 1] for i, x in enumerate(library_ids(texts, FILES[False]))}
    got: dict[int, list] = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    for i, x in ids.items():
        assert sorted(got[i]) == [(k, k * 64, len(x[k * 64 : k * 64 + 64]), crc(x[k * 64 : k * 64 + 64])) for k in range(-(-len(x) // 64))]
    used: dict[int, list] = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in used.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 64
    assert packing.pack_documents(docs.limit(0), public_tokenizers.path(FILES[False]), 64).count() == 0
    assert packing.pack_documents(frame(spark, ODD, extra=True), public_tokenizers.path(FILES[False])).select("doc_id").distinct().count() == len(ODD) + 1


def test_plain_words_and_their_marks_take_the_short_way(monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(FILES[False])
    words = ["Word,", "word", "WORD...", "plain!?", "a$%", "x&&&"]
    encoder, whole = PieceEncoder(path, False), Tokenizer.from_file(path)
    monkeypatch.setattr(encoder, "_plain_ids", lambda piece: pytest.fail(f"{piece} took the long way"))
    ids, counts = encoder.ids([*words, " ".join(words)])
    want = [whole.encode(t, add_special_tokens=False).ids for t in (*words, " ".join(words))]
    assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]
