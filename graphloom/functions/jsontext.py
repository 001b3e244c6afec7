"""Strict reading of one JSON text."""

from __future__ import annotations

import json


def strict(text: str) -> object:
    """The value of a JSON text; ValueError for repeated keys, constants that JSON has not, and what is not JSON, named by a code."""

    def once(pairs: list[tuple]) -> dict:
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("JSON_DUPLICATE_KEY")
        return dict(pairs)

    def no_constant(name: str) -> None:
        raise ValueError("JSON_CONSTANT")

    try:
        return json.loads(text, object_pairs_hook=once, parse_constant=no_constant)
    except (json.JSONDecodeError, RecursionError) as fault:
        raise ValueError("JSON_INVALID") from fault
