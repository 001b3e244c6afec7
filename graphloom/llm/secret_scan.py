r"""Operator 13: secret scans with structural confirmation.

Base kinds are patterns alone: ``assign`` (a telling name, a sign and a value of 8 or more characters), ``access`` (AKIA and
12 or more) and ``hex`` (32 or more lower-case digits). Beyond these, candidates are decoded and parsed before anything is reported:

- ``pem``: a block ``-----BEGIN ... PRIVATE KEY-----`` to its end, whose base64 body is a private key (below), an encrypted one, or, with
  the heads that say so, whole cipher blocks;
- ``key``: a run of base64 or hex outside such blocks that decodes to a private key: DER whose nested lengths add up to the last byte, as PKCS#8,
  PKCS#1, SEC 1 or DSA has them, or the OpenSSH format, whose lengths do the same;
- ``token``: a compact signed token: the first part decodes to a JSON object that names an algorithm (``none`` signs nothing and is no secret), the
  second to base64url, and the signature has the length that HMAC or ECDSA algorithms demand (RSA: 128 bytes or more). With
  five parts and ``enc``, an encrypted token.

Places are code points, ends exclusive. Spans are in order of start, then of kind as in ``KINDS``.

Defined results: a null or empty text has no spans. Every row has its own result, whatever its id, so nulls, ties and repeated rows
are kept. A column named spans is replaced, all others are kept. An empty table gives no rows. A very long text is scanned
whole in one task, in time linear in its length: candidates begin at the start of their run, and no pattern runs on beyond its own run.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import common

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "pem", "key", "token")
_ORDER = {kind: k for k, kind in enumerate(KINDS)}


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: Words in either case of ASCII alone.
_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
_ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: A text without any of these, in lower case, has no assignment.
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]{1,12} ){0,3}PRIVATE KEY)-----")
#: DER of a sequence begins with 0x30 and a length; the OpenSSH format with its name.
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_=-])(?:M[D-I]|b3BlbnNz)[A-Za-z0-9+/_-]{38,}={0,2}")
_KEY_HEX = re.compile(r"(?<![0-9A-Fa-f])(?:30|6[Ff]70656[Ee])[0-9A-Fa-f]{58,}")
_PART = r"[A-Za-z0-9_-]"
#: A JSON object's base64 begins so: a brace, then a quote or white space.
_TOKEN = re.compile(rf"(?<![A-Za-z0-9_-])e[wy]{_PART}{{8,}}(?:\.{_PART}*){{2,4}}")
_SIGNATURE = {"HS256": (32, 32), "HS384": (48, 48), "HS512": (64, 64), "ES256": (64, 64), "ES384": (96, 96), "ES512": (132, 132), "EdDSA": (64, 114)}


def unbase64(text: str) -> bytes | None:
    """The bytes of base64 in either alphabet, with or without its padding; None where it is not base64."""
    body = text.rstrip("=").translate({45: 43, 95: 47})
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_parts(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the values that fill ``data[start:end]``; None unless their lengths fill it exactly, in the shortest form."""
    out = []
    while start < end:
        if start + 2 > end or data[start] & 31 == 31:
            return None
        tag, first = data[start], data[start + 1]
        start += 2
        if first >= 128:
            size = first & 127
            if not 1 <= size <= 4 or start + size > end:
                return None
            first = int.from_bytes(data[start : start + size], "big")
            if first < 128 or first < 1 << 8 * (size - 1):
                return None
            start += size
        if start + first > end:
            return None
        out.append((tag, start, start + first))
        start += first
    return out


def der_key(data: bytes, encrypted: bool = False) -> bool:
    """Whether the bytes are one DER value that is a private key (with ``encrypted``, or an encrypted one)."""
    top = der_parts(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    inner = der_parts(data, *top[0][1:])
    if not inner:
        return False
    tags = [tag for tag, _, _ in inner]
    version = data[inner[0][1] : inner[0][2]] if tags[0] == 0x02 else None

    def algorithm(at: tuple[int, int, int]) -> bool:
        some = der_parts(data, *at[1:])
        return bool(some) and some[0][0] == 0x06 and some[0][2] > some[0][1]

    if encrypted and tags == [0x30, 0x04]:
        return algorithm(inner[0])
    if version not in (b"\0", b"\1"):
        return False
    if tags[1:3] == [0x30, 0x04] and all(t in (0xA0, 0xA1, 0x81) for t in tags[3:]):  # PKCS#8: version, algorithm, key
        return algorithm(inner[1])
    if set(tags) == {0x02} and version == b"\0" and len(tags) in (6, 9):  # DSA and PKCS#1: integers, none of them empty
        return all(b > a for _, a, b in inner)
    if tags[1:2] == [0x04] and version == b"\1" and all(t in (0xA0, 0xA1) for t in tags[2:]):  # SEC 1: version, key, curve, point
        return 16 <= inner[1][2] - inner[1][1] <= 66 and all(der_parts(data, a, b) for _, a, b in inner[2:])
    return False


_OPENSSH = b"openssh-key-v1\0"


def openssh_key(data: bytes) -> bool:
    """Whether the bytes are in the OpenSSH format: cipher, derivation, its options, public keys and private part, to the last byte."""
    if not data.startswith(_OPENSSH):
        return False
    at, left, fields = len(_OPENSSH), 3, 0
    while left:
        if at + 4 > len(data):
            return False
        size = int.from_bytes(data[at : at + 4], "big")
        at += 4 + size
        left, fields = left - 1, fields + 1
        if fields == 3:
            if at + 4 > len(data):
                return False
            keys = int.from_bytes(data[at : at + 4], "big")
            if not 1 <= keys <= len(data) // 4:
                return False
            at, left = at + 4, keys + 1
    return at == len(data)


def private_key(data: bytes | None, encrypted: bool = False) -> bool:
    return bool(data) and (der_key(data, encrypted) or openssh_key(data))


def pem_key(label: str, body: str) -> bool:
    """Whether the body of a block of this label decodes to what the label says. Line ends may be written out as ``\\n``."""
    lines = [line.strip() for line in body.replace("\\r", "\n").replace("\\n", "\n").splitlines()]
    heads = [line for line in lines if ":" in line]
    data = unbase64("".join(line for line in lines if ":" not in line))
    if any(h.startswith("DEK-Info:") for h in heads):
        return bool(data) and len(data) % 8 == 0
    return private_key(data, label.startswith("ENCRYPTED"))


def _json_object(part: str) -> dict | None:
    try:
        value = json.loads(unbase64(part) or b"")
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def signed_token(text: str) -> bool:
    """Whether this is a compact signed (three parts) or encrypted (five parts) token."""
    parts = text.split(".")
    head = _json_object(parts[0])
    if not head or not isinstance(head.get("alg"), str) or head["alg"].lower() == "none":
        return False
    rest = [unbase64(p) for p in parts[1:]]
    if any(p is None for p in rest):
        return False
    if len(parts) == 5:
        return isinstance(head.get("enc"), str) and bool(rest[1]) and bool(rest[2]) and bool(rest[3])
    least, most = _SIGNATURE.get(head["alg"], (128, 2048) if head["alg"][:2] in ("RS", "PS") else (1, 1 << 16))
    return len(parts) == 3 and bool(rest[0]) and least <= len(rest[1]) <= most


def spans_of(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets in the text."""
    if not text:
        return []
    low, out = text.lower(), []
    if any(h in low for h in _HINTS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    blocks = []
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            end = text.find("-----", m.end())
            closing = f"-----END {m[1]}-----"
            if end >= 0 and text.startswith(closing, end) and pem_key(m[1], text[m.end() : end]):
                blocks.append(("pem", m.start(), end + len(closing)))
    out += blocks
    keys = [m.span() for m in _BASE64.finditer(text) if private_key(unbase64(m[0]))]
    keys += [m.span() for m in _KEY_HEX.finditer(text) if len(m[0]) % 2 == 0 and private_key(bytes.fromhex(m[0]))]
    at, inside = 0, sorted((a, b) for _, a, b in blocks)
    for a, b in sorted(keys):
        while at < len(inside) and inside[at][1] <= a:
            at += 1
        if at == len(inside) or b <= inside[at][0]:
            out.append(("key", a, b))
    for m in _TOKEN.finditer(text):
        # A sentence may go on behind a token: its last full stop, or what follows that, is no part of it.
        parts = m[0].split(".")
        for count in (5, 3):
            some = ".".join(parts[:count])
            if len(parts) >= count and signed_token(some):
                out.append(("token", m.start(), m.start() + len(some)))
                break
    return sorted(out, key=lambda s: (s[1], _ORDER[s[0]]))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
_SPAN_TYPE = T.ArrayType(T.StructType().add("kind", "string").add("start", "long").add("stop", "long"))


@F.arrow_udf(_SPAN_TYPE)
def _spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    common.trim()
    for texts in batches:
        found = (spans_of(text.as_py()) for text in texts)
        yield pa.array([[dict(zip(("kind", "start", "stop"), s, strict=True)) for s in spans] for spans in found], _SPANS)


def with_secrets(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with ``spans`` (kind, start, stop) of the secrets in each text."""
    (found,) = common.free_names(docs, "found")
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "spans"]
    return docs.withColumn(found, _spans(F.col(text_column))).select(*others, F.col(found).alias("spans"))


def secret_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, kind, start, stop, secret): a row for each secret, with its text."""
    each = with_secrets(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))).select("id", "text", F.explode("spans").alias("s"))
    start, stop = F.col("s.start").cast("int"), F.col("s.stop").cast("int")
    return each.select("id", "s.*", F.substr("text", start + 1, stop - start).alias("secret"))


def masked(docs: DataFrame, text_column: str = "text", by: str = "[secret]") -> DataFrame:
    """``docs`` with each secret replaced by ``by``; secrets that overlap are replaced together."""
    spans, last = common.free_names(docs, "spans", "last")
    found = docs.withColumn(spans, _spans(F.col(text_column)))
    # Overlapping spans, in order of their starts, are merged; then what stands between them is joined.
    empty = F.array().cast("array<struct<start:bigint,stop:bigint>>")

    def merge(seen, s):
        end = F.element_at(seen, -1)
        wider = F.concat(F.slice(seen, 1, F.size(seen) - 1), F.array(F.struct(end.start.alias("start"), F.greatest(end.stop, s.stop).alias("stop"))))
        return F.when((F.size(seen) > 0) & (s.start < F.get(seen, F.size(seen) - 1).stop), wider).otherwise(
            F.concat(seen, F.array(F.struct(s.start.alias("start"), s.stop.alias("stop")))))

    merged = F.when(F.size(spans) > 0, F.aggregate(spans, empty, merge)).otherwise(empty)
    found = found.withColumn(last, merged)
    at = lambda k: F.coalesce(F.get(last, k - 1)["stop"], F.lit(0)).cast("int")
    upto = lambda k: F.coalesce(F.get(last, k)["start"], F.length(text_column).cast("long")).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.size(last)), lambda k: F.substr(F.col(text_column), at(k) + 1, upto(k) - at(k)))
    whole = F.when(F.size(last) > 0, F.array_join(pieces, by)).otherwise(F.col(text_column))
    return found.withColumn(text_column, whole).select(*[F.col(f"`{c}`") for c in docs.columns])


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_secrets(common.table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    of_kinds = lambda *kinds: F.filter("spans", lambda s: s.kind.isin(*kinds))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.stop)), ",")
    return found.select(
        "doc_id", *[F.size(of_kinds(kind)).cast("long").alias(f"n_{kind}") for kind in BASE],
        F.sha2(joined(of_kinds(*BASE)).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )
