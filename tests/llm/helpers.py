"""Brute-force counterparts and odd inputs for the operators' tests."""

from __future__ import annotations

import re

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Names that the operators give to columns of their own.
CLASHES = (
    "c_id", "C_TEXT", "lines", "fence", "covered", "x_id", "X_KEY", "text_key", "row", "gl_id", "gl_text", "at", "found", "h", "n", "class", "grp",
    "component_id", "segment", "place", "mark", "recipe", "last", "label", "l_id",
)
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def frame(spark, texts, extra=False):
    """Documents 0.. with these texts; ``extra`` adds a null id, a repeated row and columns with clashing names."""
    rows = [(i, t, "en", "src0", len(t) if t is not None else None) for i, t in enumerate(texts)]
    if not extra:
        return spark.createDataFrame(rows, DOCS)
    rows += [(None, "a text without an id", None, None, None), rows[0]]
    clash = "row long, label string, n long, score string, class string, grp string, covered string, lines string, keep_id string, token string"
    return spark.createDataFrame([r + (None,) * 10 for r in rows], DOCS + ", " + clash)


def shingles(text: str | None) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def components(texts: dict[int, str | None]) -> dict[int, tuple[int, int]]:
    """(set size, component) of each document, by comparing all pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


ODD = [
    "", None, " ", "one", "One two three four", "x " * 30_000, "same text here with some words in it", "same text here with some words in it",
    "\n\n\n\n", "é ü 日本語   \x1c odd", "a,b;c.d", "y" * 200_000, "the end <|endoftext|> of it", "line\nline\nline\nline\nline",
]
