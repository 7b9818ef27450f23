"""Secret scans with structural confirmation.

``secret_spans`` is a row-local column function, so its plan is a scan and one
Arrow-batched Python step: no shuffle, nothing gathered, any executor may be
lost and only its tasks run again.

Base patterns report what merely looks like a secret.  The method adds spans
whose *structure* proves them: a base64 or hex candidate is decoded and must
parse as a key encoding (nested DER lengths that fill their parents exactly, an
OpenSSH key container whose length-prefixed fields add up), or be a signed
token whose header decodes to a JSON object that names an algorithm.  Keys may
be wrapped in lines of any width, also with line ends written as ``\\n`` or as
string literals that are joined, stand in armour
with header lines, or follow a joining character such as ``/`` or ``_``.  The
outer length of a key tells whether a candidate can be one before it is decoded.

Defined cases: a null text is the empty text and has no spans; an empty table
gives no rows; repeated rows each get their own result; spans of different kinds
may overlap and are all kept; the order is by start, then kind as listed in
``KINDS``; what is longer than ``LARGEST_KEY`` bytes or has more than
``MOST_VALUES`` values or fields is no key; texts of any length are scanned whole,
in time that is linear but for these two bounds; further columns play no part,
whatever their names.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import count_kind, span_list, table, text_of

#: Kinds in the order that breaks ties between spans of one start.
KINDS = ("assign", "access", "hex", "pem_key", "der_key", "ssh_key", "signed_token")
BASE_KINDS = KINDS[:3]
SPAN_TYPE = "array<struct<kind:string,start:int,end:int>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

# The base patterns.
_ASSIGN = re.compile(
    r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
# What the structural checks look at.
_BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,64}?(?:PRIVATE|PUBLIC) KEY)-----")
_END = re.compile(r"-----END ([A-Z0-9 ]{0,64}?(?:PRIVATE|PUBLIC) KEY)-----")
_HEADER = re.compile(r"([A-Za-z-]+): ([!-~ ]*)")
_DEK = re.compile(r"[A-Z0-9-]+,[0-9A-Fa-f]{16,}")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
_BREAK = re.compile(r"\\r\\n|\\n|\\r|\r\n|\n|\r")
#: A line of base64: bare, or as a string literal that the next one continues.
_BARE = re.compile(r"[\x20\t]*([A-Za-z0-9+/_-]+={0,2})[\x20\t\\]*")
_QUOTED = re.compile(r"""[\x20\t+.]*(?:["'])([A-Za-z0-9+/_-]*={0,2})(?:["'])[\x20\t+.,;)\\]*""")
#: Words before a key on its first line, such as an assignment.
_BEFORE = re.compile(r"""[^"'=:\x20\t]{0,64}[\x20\t]*(?:[:=][\x20\t]*)?[("'\x20\t]*(?=M|AAAA|b3B)""")
_OPENS = ("M", "AAAA", "b3B")
_JOINER = re.compile(r"[/+_-](?=M|AAAA|b3B)")
_SIGNED = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
_LONG_HEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}(?![0-9A-Fa-f])")


#: No key is longer, in bytes, or has more values or fields.
LARGEST_KEY = 1 << 16
MOST_VALUES = 256


def decode_base64(run: str) -> bytes | None:
    """The bytes of a standard or URL-safe base64 run, or None."""
    body = run.rstrip("=").translate(str.maketrans("-_", "+/"))
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _der_header(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, first and last byte of the value at ``at``; None if it does not fit."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > end:
            return None
        size = int.from_bytes(data[at : at + n], "big")
        at += n
        if size < 0x80:
            return None  # not the shortest form
    return (tag, at, at + size) if at + size <= end else None


def _der_fills(data: bytes, at: int, end: int) -> int:
    """Number of values nested in data[at:end] if each fills its parent exactly, else 0."""
    count, open_ends = 0, [end]
    while open_ends:
        if at == open_ends[-1]:
            open_ends.pop()
            continue
        got = _der_header(data, at, open_ends[-1])
        if got is None:
            return 0
        tag, first, last = got
        count += 1
        if count > MOST_VALUES:
            return 0
        if tag & 0x20:
            open_ends.append(last)
            at = first
        else:
            at = last
    return count


def is_der_key(data: bytes) -> bool:
    """Whether bytes are one DER sequence, of a size and shape that keys have.

    The outer sequence must span the input exactly, every nested length must
    fill its parent, and it must open with an integer (private keys) or with an
    algorithm sequence that holds an object identifier (public keys).
    """
    if len(data) < 32 or data[0] != 0x30:
        return False
    outer = _der_header(data, 0, len(data))
    if outer is None or outer[2] != len(data):
        return False
    first = _der_header(data, outer[1], outer[2])
    if first is None or _der_fills(data, outer[1], outer[2]) < 3:
        return False
    if first[0] == 0x02:
        return True
    return first[0] == 0x30 and first[1] < first[2] and data[first[1]] == 0x06


def _fields(data: bytes, at: int, end: int) -> list[bytes] | None:
    """The length-prefixed fields that fill data[at:end], or None."""
    out = []
    while at < end:
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > end:
            return None
        out.append(data[at + 4 : at + 4 + size])
        at += 4 + size
        if len(out) > MOST_VALUES:
            return None
    return out


def _is_ssh_public(data: bytes) -> bool:
    fields = _fields(data, 0, len(data))
    return fields is not None and len(fields) >= 2 and fields[0].startswith((b"ssh-", b"ecdsa-", b"sk-"))


def _is_ssh_container(data: bytes) -> bool:
    """Whether cipher, kdf, options, keys and private part of a container add up to its last byte."""
    at, head = len(b"openssh-key-v1\0"), []
    for _ in range(3):
        size = int.from_bytes(data[at : at + 4], "big")
        head.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    if at + 4 > len(data) or not head[0] or not head[1]:
        return False
    keys = int.from_bytes(data[at : at + 4], "big")
    fields = _fields(data, at + 4, len(data))
    if not fields or keys < 1 or len(fields) != keys + 1:
        return False
    return all(map(_is_ssh_public, fields[:-1])) and len(fields[-1]) >= 8


def is_ssh_key(data: bytes) -> bool:
    """Whether bytes are an OpenSSH key: a container, or a public key's length-prefixed fields."""
    return _is_ssh_container(data) if data.startswith(b"openssh-key-v1\0") else _is_ssh_public(data)


def _der_size(head: str) -> int | None:
    """The whole size of a DER sequence, from the first characters of its base64."""
    data = decode_base64(head[:8]) or b""
    if len(data) < 6 or data[0] != 0x30:
        return None
    size, start = data[1], 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4:
            return None
        size, start = int.from_bytes(data[2 : 2 + n], "big"), 2 + n
    return start + size if start + size <= LARGEST_KEY else None


def _ssh_opens(head: str) -> bool:
    """Whether the first characters of a base64 run open an OpenSSH key or container."""
    data = decode_base64(head[:32]) or b""
    if data.startswith(b"openssh-key-v1"):
        return True
    return data[4:].startswith((b"ssh-", b"ecdsa-", b"sk-")) and 7 <= int.from_bytes(data[:4], "big") <= 64


def _key_kind(run: str, at: int = 0) -> str | None:
    """What sort of key a base64 run is from ``at`` to its end; the head is looked at before the rest."""
    end = len(run) - 1 if run.endswith("=") else len(run)
    end -= run.endswith("==")
    size = (end - at) * 3 // 4
    if size > LARGEST_KEY:
        return None
    if run.startswith("M", at):  # a DER sequence, whose first bytes tell its length
        if _der_size(run[at : at + 8]) != size:
            return None
    elif not run.startswith(("AAAA", "b3B"), at) or not _ssh_opens(run[at : at + 32]):
        return None
    data = decode_base64(run[at:])
    if not data:
        return None
    return "der_key" if is_der_key(data) else "ssh_key" if is_ssh_key(data) else None


def _ssh_ends(run: str, start: int) -> Iterator[int]:
    """How many bytes an OpenSSH key that opens at ``start`` of a base64 run can have: where its fields may end.

    Only the lengths of fields are decoded.
    """

    def number(at: int) -> int | None:
        data = decode_base64(run[start + at // 3 * 4 : start + at // 3 * 4 + 8]) or b""
        part = data[at % 3 : at % 3 + 4]
        return int.from_bytes(part, "big") if len(part) == 4 else None

    container = run.startswith("b3B", start)
    at, fields, most = (len(b"openssh-key-v1\0"), 0, 3) if container else (0, 0, MOST_VALUES)
    while fields < most and at <= LARGEST_KEY:
        size = number(at)
        if size is None:
            return
        at += 4 + size
        fields += 1
        if not container and fields >= 2:
            yield at
        if container and fields == 3 == most:
            keys = number(at)
            if not keys or keys >= MOST_VALUES:
                return
            at, most = at + 4, 3 + keys + 1
    if container and fields == most:
        yield at


def _line_run(line: str) -> str | None:
    """The base64 of a line that is nothing else, but for quotes and what joins string literals; None if it is more."""
    m = _BARE.fullmatch(line) or _QUOTED.fullmatch(line)
    return m[1] if m else None


def _is_armoured(body: str) -> bool:
    """Whether what stands between the lines of an armour is a key, or an encrypted key."""
    lines = [x for x in _BREAK.split(body)]
    headers, runs = {}, []
    for line in lines:
        plain = line.strip("\x20\t\"'+,;\\")
        header = _HEADER.fullmatch(line.strip())
        if header and not runs:
            headers[header[1]] = header[2]
        elif plain:
            run = _line_run(line)
            if run is None:
                return False
            runs.append(run)
    run = "".join(runs)
    if len(run) > LARGEST_KEY * 4 // 3 + 4:
        return False
    if "ENCRYPTED" in headers.get("Proc-Type", ""):
        data = decode_base64(run)
        return bool(data) and len(data) % 8 == 0 and _DEK.fullmatch(headers.get("DEK-Info", "").strip()) is not None
    return _key_kind(run) is not None


def armoured(text: str) -> Iterator[tuple[int, int]]:
    """Spans of armours that hold keys: a BEGIN line, the END line of its label before any other BEGIN, a key between."""
    ends: dict[str, list[re.Match]] = {}
    for m in _END.finditer(text):
        ends.setdefault(m[1], []).append(m)
    begins = list(_BEGIN.finditer(text))
    for begin, after in zip(begins, [*(m.start() for m in begins[1:]), len(text)]):
        mine = ends.get(begin[1], [])
        at = bisect_left(mine, begin.end(), key=lambda m: m.start())
        if at < len(mine) and mine[at].end() <= after and _is_armoured(text[begin.end() : mine[at].start()]):
            yield begin.start(), mine[at].end()


def wrapped(text: str) -> Iterator[tuple[str, int, int]]:
    """Keys (kind, start, end) in base64 over several lines of any width, real or escaped, bare or as string literals.

    The head of a key tells its length, so each line that opens like one is held
    against the sum of the lines from there, and joined only where it fits.
    """
    edges = [0]
    spans = []  # (start, end) of each line
    for m in _BREAK.finditer(text):
        spans.append((edges[-1], m.start()))
        edges.append(m.end())
    spans.append((edges[-1], len(text)))
    block: list[tuple[str, int, int]] = []  # consecutive lines of base64: run, and where it stands

    def keys() -> Iterator[tuple[str, int, int]]:
        plain = [r.rstrip("=") for r, _, _ in block]
        total = list(accumulate(map(len, plain), initial=0))
        whole = "".join(plain)
        i = 0

        def end_of(size: int) -> int | None:
            """The line at whose end so many bytes from line i end, if it is a later one."""
            chars = total[i] + -(-size * 4 // 3)
            last = bisect_left(total, chars)
            return last if i + 1 < last < len(total) and total[last] == chars else None

        while i < len(block) - 1:
            run, start, _ = block[i]
            found, head = None, whole[total[i] : total[i] + 32]
            if run.startswith("M") and (size := _der_size(head)):
                found = end_of(size)
            elif run.startswith(("AAAA", "b3B")) and _ssh_opens(head):
                fit = [e for size in _ssh_ends(whole, total[i]) if (e := end_of(size))]
                found = fit[-1] if fit else None
            kind = _key_kind("".join(r for r, _, _ in block[i:found])) if found else None
            if kind:
                yield kind, start, block[found - 1][2]
                i = found
            else:
                i += 1

    for a, b in spans:
        line = text[a:b]
        run = _line_run(line) if b > a else None
        if run:
            at = line.index(run)
        elif b > a and (m := _BEFORE.match(line)) and (tail := _line_run(line[m.end() :].rstrip("\x20\t\"'+,;\\"))):
            yield from keys()  # a first line with words before the key
            block = []
            run, at = tail, m.end()
        if not run:
            yield from keys()
            block = []
            continue
        block.append((run, a + at, a + at + len(run)))
    yield from keys()


def is_signed_token(run: str) -> bool:
    """Whether ``a.b.c`` has a JSON header that names an algorithm."""
    head = decode_base64(run.split(".", 1)[0])
    try:
        header = json.loads(head or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """All spans of one text, as (kind, start, end) in the defined order."""
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    if "-----BEGIN " in text:
        out += [("pem_key", *span) for span in armoured(text)]
    for m in _BASE64.finditer(text):
        run = m[0]
        for at in (0, *(j.end() for j in _JOINER.finditer(run))):
            kind = _key_kind(run, at) if len(run) - at >= 40 and run.startswith(_OPENS, at) else None
            if kind:
                out.append((kind, m.start() + at, m.end()))
                break
    if any(o in text for o in ("\n", "\\n", "\r", "\\r")) and any(o in text for o in ("MI", "MC", "MF", "MH", "MD", "ME", "MG", "AAAA", "b3B")):
        told = {(a, b) for _, a, b in out}
        out += [k for k in wrapped(text) if k[1:] not in told]
    for m in _LONG_HEX.finditer(text):
        if m[0][:2] == "30" and len(m[0]) % 2 == 0 and is_der_key(bytes.fromhex(m[0])):
            out.append(("der_key", *m.span()))
    if "eyJ" in text:
        out += [("signed_token", *m.span()) for m in _SIGNED.finditer(text) if is_signed_token(m[0])]
    if len(out) > 1:
        out.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return out


def _find_batch(texts: pa.Array) -> pa.Array:
    return pa.array(
        [[{"kind": k, "start": a, "end": b} for k, a, b in find_secrets(t or "")] for t in texts.to_pylist()],
        type=_ARROW,
    )


def secret_spans(text: Column) -> Column:
    """Column of spans ``array<struct<kind, start, end>>`` of a text column."""
    return F.arrow_udf(_find_batch, SPAN_TYPE)(text)


def redact_secrets(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``df`` with every reported span of the text replaced; null stays null."""

    def cut(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            if t is not None:
                at, parts = 0, []
                for _, a, b in find_secrets(t):
                    if b > at:
                        parts += [t[at:a], mark] if a >= at else []
                        at = b
                t = "".join([*parts, t[at:]])
            out.append(t)
        return pa.array(out, type=pa.string())

    return df.withColumn(text_col, F.arrow_udf(cut, "string")(df[text_col]))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digest of base spans, all spans."""
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", secret_spans(text_of(docs)).alias("found"))
    base = F.filter(F.col("found"), lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        count_kind(F.col("found"), "assign").alias("n_assign"),
        count_kind(F.col("found"), "access").alias("n_access"),
        count_kind(F.col("found"), "hex").alias("n_hex"),
        F.sha2(span_list(base), 256).alias("base_sha256"),
        span_list(F.col("found")).alias("spans"),
    )


QUERIES = {"op5_secret_scan": op5_secret_scan}
ORACLE_SQL: dict[str, str] = {}
