"""Secret scan: patterns, then structural confirmation of encoded candidates."""
from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, texts

# Fixed values of the base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "signed_token", "key_der", "key_ssh", "key_pem")

#: Candidates for decoding: long runs of one alphabet. Shorter runs cannot hold a key's structure.
#: Signed tokens are searched at every part of a dotted run; what their header says is left to the structure.
SIGNED = re.compile(r"(?<![A-Za-z0-9_-])(?=([A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{2,}+\.[A-Za-z0-9_-]*+))")
LONG_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
#: A line break, as itself or escaped as in JSON and environment files.
BREAK = r"(?:\r?\n|\\r\\n|\\n)"
LINE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/]{40,}+")
NEXT_LINE = re.compile(BREAK + r"([A-Za-z0-9+/]++={0,2})")
PEM = re.compile(rf"-----BEGIN ([A-Z0-9 ]*)PRIVATE KEY-----((?:{BREAK}[A-Za-z-]+:[^\r\n\\]*)*)((?:[A-Za-z0-9+/=\s]|\\r|\\n)++)-----END \1PRIVATE KEY-----")
CIPHER = re.compile(r"DEK-Info:\x20*[A-Z0-9-]+,((?:[0-9A-Fa-f]{16}){1,2})(?![0-9A-Fa-f])")
SSH_MAGIC = b"openssh-key-v1\0"
SSH_KINDS = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-")


def _decoded(run: str) -> Iterator[bytes]:
    """The bytes that a run may stand for: hexadecimal, base64 or its URL form."""
    if len(run) % 2 == 0 and re.fullmatch("[0-9a-fA-F]+", run):
        yield bytes.fromhex(run)
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 != 1:
        try:
            yield base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
        except binascii.Error:
            return


def _der(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, begin and end of the value that starts at `at`; none if its length does not fit into [at, end)."""
    if at + 2 > end:
        return None
    tag, length, at = data[at], data[at + 1], at + 2
    if length >= 0x80:
        more = length & 0x7F
        if not 1 <= more <= 4 or at + more > end:
            return None
        length, at = int.from_bytes(data[at:at + more], "big"), at + more
    return (tag, at, at + length) if at + length <= end else None


def is_der_key(data: bytes) -> bool:
    """A sequence that fills the data, whose parts fill it in turn, and whose parts are those of a key.

    Private keys begin with a small version number, followed by a large number (RSA), an octet string (elliptic curve) or
    an algorithm sequence (any kind); a public key is an algorithm sequence and a bit string.
    """
    outer = _der(data, 0, len(data))
    if not outer or outer[0] != 0x30 or outer[2] != len(data):
        return False
    parts, at = [], outer[1]
    while at < outer[2]:
        part = _der(data, at, outer[2])
        if part is None:
            return False
        parts.append(part)
        at = part[2]
    tags = [tag for tag, _, _ in parts]
    named = lambda k: tags[k] == 0x30 and (first := _der(data, parts[k][1], parts[k][2])) is not None and first[0] == 0x06
    if len(tags) == 2:
        return named(0) and tags[1] == 0x03
    if len(tags) < 3 or tags[0] != 0x02 or parts[0][2] - parts[0][1] != 1:
        return False
    return (tags[1] == 0x04 and tags[2] >= 0xA0) or (named(1) and tags[2] == 0x04) or (len(tags) >= 5 and set(tags) == {0x02} and parts[1][2] - parts[1][1] >= 32)


def _fields(data: bytes, at: int, count: int | None = None) -> tuple[list[bytes], int] | None:
    """`count` length-prefixed fields from `at` (or as many as fill the data) and where they end; none if one does not fit."""
    fields: list[bytes] = []
    while len(fields) < count if count is not None else at < len(data):
        end = at + 4 + int.from_bytes(data[at:at + 4], "big")
        if at + 4 > len(data) or end > len(data):
            return None
        fields.append(data[at + 4:end])
        at = end
    return fields, at


def is_ssh_key(data: bytes) -> bool:
    """Length-prefixed fields that fill the data, the first of them the name of a key kind; or the private-key container.

    The container holds a cipher, a derivation with its options, a number of public keys and one private part, to its end.
    A private part in clear begins with a number twice and the first key's kind, and fills blocks of 8 bytes; one under a
    cipher fills such blocks, and may be followed by a tag of 16 bytes.
    """
    if not data.startswith(SSH_MAGIC):
        found = _fields(data, 0)
        return found is not None and len(found[0]) >= 2 and found[0][0].startswith(SSH_KINDS)
    head = _fields(data, len(SSH_MAGIC), 3)
    if head is None or head[1] + 4 > len(data):
        return False
    (cipher, derivation, options), at = head
    keys = int.from_bytes(data[at:at + 4], "big")
    if not 1 <= keys <= len(data) // 8 or (cipher == b"none") != (derivation == b"none") or (cipher == b"none" and options):
        return False
    body = _fields(data, at + 4, keys + 1)
    if body is None:
        return False
    (*public, private), at = body
    if not all(is_ssh_key(key) for key in public) or len(private) < 16 or len(private) % 8:
        return False
    if cipher != b"none":
        return len(data) - at in (0, 16)
    kind = _fields(public[0], 0, 1)[0]
    named = _fields(private, 8, 1)
    return at == len(data) and private[:4] == private[4:8] and named is not None and named[0] == kind


def is_signed_token(run: str) -> bool:
    """Header and claims are JSON objects, and the header names the algorithm of the signature."""
    try:
        header, claims = (json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))) for part in run.split(".")[:2])
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(claims, dict) and isinstance(header.get("alg"), str)


def _key_kind(run: str) -> str | None:
    for data in _decoded(run):
        if is_der_key(data):
            return "key_der"
        if is_ssh_key(data):
            return "key_ssh"
    return None


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(begin, end, kind) of the three plain patterns, in code points."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=_order)


def _pem_kind(headers: str, body: str) -> bool:
    """A key behind the lines of a PEM body; or, where its headers name a cipher, whole blocks of it."""
    body = re.sub(r"\\[rn]|\s", "", body)
    if not (cipher := CIPHER.search(headers)):
        return _key_kind(body) is not None
    block = len(cipher[1]) // 2
    return any(len(data) >= 2 * block and len(data) % block == 0 for data in _decoded(body))


def _wrapped(text: str) -> Iterator[tuple[int, int, str]]:
    """(begin, end, kind) of keys over several lines of one width, the last of which may be shorter."""
    at = 0
    while line := LINE.search(text, at):
        width, end, parts = len(line[0]), line.end(), [line[0]]
        last = NEXT_LINE.match(text, end)
        while last and len(last[1]) == width:
            end = last.end()
            parts.append(last[1])
            last = NEXT_LINE.match(text, end)
        at = end
        ends = [(last.end(), last[1])] if last and len(last[1]) < width else []
        for stop, tail in [*ends, *([(end, "")] if len(parts) > 1 else [])]:
            if kind := _key_kind("".join(parts) + tail):
                at = stop
                yield line.start(), stop, kind
                break


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """(begin, end, kind) of encoded runs whose decoded bytes have the structure of a key or signed token."""
    found = [(m.start(), m.end(1), "signed_token") for m in SIGNED.finditer(text) if is_signed_token(m[1])]
    pems = []
    if "PRIVATE KEY-----" in text:
        pems = [(m.start(), m.end()) for m in PEM.finditer(text) if _pem_kind(m[2], m[3])]
    found += [(a, b, "key_pem") for a, b in pems]
    for m in LONG_RUN.finditer(text):
        if kind := _key_kind(m[0]):
            found.append((m.start(), m.end(), kind))
    if "\n" in text or "\\n" in text:
        starts = [a for a, _ in pems]
        for span in _wrapped(text):
            pem = bisect_right(starts, span[0]) - 1
            if pem < 0 or span[0] >= pems[pem][1]:      # the lines of a PEM body are reported with it
                found.append(span)
    return found


def _order(span: tuple[int, int, str]) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{begin}:{end}" for begin, end, kind in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("base", pa.string()), ("spans", pa.string()),
                        *[(f"n_{k}", pa.int64()) for k in KINDS]])
    for part in chunks(batches):
        rows = []
        for text in part.column("text").to_pylist():
            base = base_spans(text)
            all_spans = sorted(base + confirmed_spans(text), key=_order)
            kinds = [kind for _, _, kind in all_spans]
            rows.append((written(base), written(all_spans), *[kinds.count(k) for k in KINDS]))
        columns = list(zip(*rows, strict=True))
        yield pa.record_batch([part.column("doc_id"), *[pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True)]], schema=schema)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of every whole text: one row per document with its spans, `kind:start:end` in code points, comma-joined.

    `base` has the matches of the plain patterns, `spans` these and what the structural check adds: candidates are decoded
    from base64 or hexadecimal and reported only if nested lengths and fields are those of a key, or header and claims
    those of a signed token. Lines of one width are joined before they are decoded, whether their breaks are
    real or escaped. Nothing is taken away from the base matches. One pass, no shuffle; a task holds one slice of
    texts at a time.

    Null or empty text: no spans, empty strings. Very long texts are scanned whole, in time that grows with their length. Null and repeated ids are kept as they are, one row each. An empty table
    gives no rows. Other columns are ignored.
    """
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return texts(docs, id_col, text_col).mapInArrow(_scan, f"doc_id long, base string, spans string, {counts}")
