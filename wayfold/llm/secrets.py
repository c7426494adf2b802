"""Secrets in texts, confirmed by their structure.

Names with values, access key ids and long hexadecimal runs are found by pattern. Longer base64 and hexadecimal runs, armoured
blocks and signed tokens are reported only once they are decoded and their inside holds: nested lengths of a
key encoding must add up, and a token's header must be an object that names its algorithm.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .words import give_back

# The base patterns and the least lengths of their matches.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]+"
ACCESS_LEAST = 20
HEX = r"[0-9a-f]+"
HEX_LEAST = 24

# Kinds in the order that decides between spans with one start.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "block", "key", "token")
SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))

_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
# A match is a whole run, so that asking for the least length in the pattern drops just the matches that are too short.
_ACCESS = re.compile(rf"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}")
_HEX = re.compile(rf"[0-9a-f]{{{HEX_LEAST},}}")
# The dashes after a mark may be those before the next one.
_MARK = re.compile(r"-----(BEGIN|END) ((?:[A-Z0-9]{1,20} ){0,3}PRIVATE KEY)(?=-----)")
# Tried once per run of token characters, and only if two more runs follow it, so that the time is linear in the text.
_TOKEN = re.compile(
    r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.)[A-Za-z0-9_-]*?\b(eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]*+)"
)
# An encoded key begins with a sequence (30 in hexadecimal), an armoured one with dashes, a token with a brace.
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:M[A-Za-z0-9+/_-]|LS0|b3B|ZXl)[A-Za-z0-9+/_-]{38,}={0,2}")
# Nothing but the run may stand between the ends of its lines.
_NEXT_LINE = re.compile(r"[ \t]*\r?\n[ \t]*([A-Za-z0-9+/_-]+={0,2})(?![A-Za-z0-9+/_=-])")
# The same beginnings in hexadecimal: a sequence, dashes, the ssh tools' first word, a token's brace.
_HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])(?=[0-9A-Fa-f]{64})(?:30|2[Dd]2[Dd]2[Dd]|6[Ff]70656[Ee]|65794[Aa])[0-9A-Fa-f]+")

SSH_MAGIC = b"openssh-key-v1\x00"
#: Object ids of the password-based schemes begin so.
PKCS_OID = bytes.fromhex("2a864886f70d01")


def _element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, begin and end of the content of the element at `at`; None if its length is not in shortest form or goes beyond `end`."""
    if at + 2 > end:
        return None
    tag, length, begin = data[at], data[at + 1], at + 2
    if length >= 128:
        n = length - 128
        if not 1 <= n <= 4 or begin + n > end:
            return None
        length, begin = int.from_bytes(data[begin : begin + n], "big"), begin + n
        if length < 128 or length >> (8 * (n - 1)) == 0:
            return None
    return (tag, begin, begin + length) if begin + length <= end else None


def _elements(data: bytes, begin: int, end: int, most: int = 16) -> list[tuple[int, int, int]] | None:
    """The elements that fill begin..end exactly; None if they do not, or are more than any key encoding has."""
    out = []
    while begin < end:
        element = _element(data, begin, end)
        if element is None or len(out) == most:
            return None
        out.append(element)
        begin = element[2]
    return out


def is_private_key(data: bytes) -> bool:
    """Whether `data` is one encoded private key: every nested length adds up and the parts are those of a known layout."""
    top = _element(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return False
    parts = _elements(data, top[1], top[2])
    if not parts:
        return False
    tags = [p[0] for p in parts]
    size = [p[2] - p[1] for p in parts]
    version = data[parts[0][1]] if tags[0] == 2 and size[0] == 1 else None

    def scheme(part: tuple[int, int, int]) -> bytes:
        inner = _elements(data, part[1], part[2]) or [(0, 0, 0)]
        return data[inner[0][1] : inner[0][2]] if inner[0][0] == 6 else b""

    if tags == [2] * 9:
        return version in (0, 1) and size[1] >= 32
    if tags == [2] * 6:
        return version == 0 and size[1] >= 32
    if tags[:2] == [2, 4]:
        return version == 1 and 16 <= size[1] <= 72 and set(tags[2:]) <= {0xA0, 0xA1}
    if tags[:3] == [2, 0x30, 4]:
        return version in (0, 1) and bool(scheme(parts[1])) and size[2] >= 16 and set(tags[3:]) <= {0xA0, 0xA1, 0x81}
    if tags == [0x30, 4]:
        return scheme(parts[0]).startswith(PKCS_OID) and size[1] >= 16
    return False


def is_ssh_key(data: bytes) -> bool:
    """Whether `data` is a private key file of the ssh tools: four texts with lengths before them, a count between, nothing after."""
    if not data.startswith(SSH_MAGIC):
        return False
    at, texts = len(SSH_MAGIC), []
    for k in range(6):
        if at + 4 > len(data):
            return False
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if k == 3:
            if n != 1:
                return False
            continue
        texts.append(data[at : at + n])
        at += n
        if at > len(data):
            return False
    return at == len(data) and bool(texts[0]) and len(texts[4]) % 8 == 0


def _decoded(run: str) -> bytes | None:
    text = run.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _object(part: str) -> dict | None:
    data = _decoded(part)
    try:
        found = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def is_signed_token(run: str) -> bool:
    """Whether `run` is header.body.signature: two encoded objects, the first naming the algorithm, and a signature where it needs one."""
    head, body, signature = run.split(".")
    first = _object(head)
    if first is None or not isinstance(first.get("alg"), str) or _object(body) is None:
        return False
    return first["alg"].lower() == "none" or len(_decoded(signature) or b"") >= 16


def _is_secret(data: bytes | None) -> bool:
    """What a decoded run must be: a key, or text that is an armoured key or a token itself."""
    if not data:
        return False
    if is_private_key(data) or is_ssh_key(data):
        return True
    if not data.startswith((b"-----BEGIN ", b"eyJ")):
        return False
    try:
        text = data.decode("ascii")
    except UnicodeDecodeError:
        return False
    return bool(_blocks(text)) or any(is_signed_token(m[1]) for m in _TOKEN.finditer(text))


def _blocks(text: str) -> list[tuple[int, int]]:
    """Spans of armoured private keys whose body decodes to a key; header lines of old files mark an encrypted body, taken as it is.

    A body holds no mark, so a block runs from the last BEGIN before an END, and every body is read once.
    """
    out, begin = [], None
    for m in _MARK.finditer(text):
        if m[1] == "END" and begin is not None and begin[2] == m[2]:
            lines = text[begin.end() + 5 : m.start()].replace("\\n", "\n").split("\n")
            encrypted = any(x.startswith("DEK-Info:") for x in lines)
            data = _decoded("".join(x.strip() for x in lines if ":" not in x))
            if data and (len(data) % 8 == 0 if encrypted else is_private_key(data) or is_ssh_key(data)):
                out.append((begin.start(), m.end() + 5))
        begin = m if m[1] == "BEGIN" else None
    return out


def _wrapped_end(text: str, first: re.Match) -> int | None:
    """Where a secret ends whose base64 begins with `first` and goes on in the next lines, all as wide as it but the last; None if it is none."""
    most, head = None, _decoded(first[0][:8])
    if head and head[0] == 0x30:  # a key says how long it is, so that no more lines are read
        n = max(head[1] - 128, 0)
        if n > 4:
            return None
        size = 2 + n + (int.from_bytes(head[2 : 2 + n], "big") if n else head[1])
        most = -(-size * 8 // 6)
    elif first[0].startswith("M"):
        return None
    parts, ends, length = [first[0]], [first.end()], len(first[0])
    while (most is None or length < most) and len(parts[-1]) == len(first[0]) and (line := _NEXT_LINE.match(text, ends[-1])) and len(line[1]) <= len(first[0]):
        parts.append(line[1])
        ends.append(line.end())
        length += len(line[1])
    # The last line may be a word that follows.
    for k in (len(parts), len(parts) - 1):
        if k > 1 and _is_secret(_decoded("".join(parts[:k]))):
            return ends[k - 1]
    return None


def spans_of(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets of `text` in code points, by start, then kind."""
    if not text:
        return []
    out = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    if "-----BEGIN " in text:
        out += [("block", *span) for span in _blocks(text)]
    for m in _BASE64.finditer(text):
        end = m.end() if _is_secret(_decoded(m[0])) else _wrapped_end(text, m)
        if end is not None:
            out.append(("key", m.start(), end))
    out += [("key", *m.span()) for m in _HEX_KEY.finditer(text) if len(m[0]) % 2 == 0 and _is_secret(bytes.fromhex(m[0]))]
    if "eyJ" in text:
        out += [("token", *m.span(1)) for m in _TOKEN.finditer(text) if is_signed_token(m[1])]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


@pandas_udf(SPANS)
def secret_spans(text: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in spans_of(t)] for t in text])


def masked(text: str | None, spans: list) -> str | None:
    """`text` with every span of `spans` replaced by <KIND>; spans that overlap become one, named after the first."""
    if text is None or spans is None or not len(spans):
        return text
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at : s["start"]], f"<{s['kind'].upper()}>"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id (as it is, null too) and spans, an array of (kind, start, end) in code points, end exclusive,
    by start, then kind. A null or empty text has none. Whole texts are read, whatever their length; other columns are not."""
    return docs.select("doc_id", secret_spans(F.col("text")).alias("spans"))


def mask_secrets(docs: DataFrame) -> DataFrame:
    """`docs` with each secret in `text` replaced by its kind in angle brackets and n_chars, if there, counted again. All rows and
    columns stay; a null text stays null."""
    schema = docs.schema

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                names, columns = part.schema.names, list(part.columns)
                texts = part.column("text").to_pylist()
                texts = [masked(t, [{"kind": k, "start": a, "end": b} for k, a, b in spans_of(t)]) for t in texts]
                columns[names.index("text")] = pa.array(texts, pa.string())
                if "n_chars" in names:
                    columns[names.index("n_chars")] = pa.array([None if t is None else len(t) for t in texts], part.column("n_chars").type)
                yield pa.RecordBatch.from_arrays(columns, names=names)
            give_back()

    return docs.mapInArrow(mask, schema)


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
