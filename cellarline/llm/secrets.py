"""Secret scan with structural confirmation.

Base findings are runs that look like secrets (assignments, access ids, hexadecimal runs). Beyond them a run of
base64 or hexadecimal text is reported only if what it decodes to has the structure of a secret: key encodings are
walked through all their nested lengths, and the header of a signed token must be a JSON object with an algorithm.

Null and empty texts have no spans. Repeated rows are scanned one by one and keep their rows. Texts are scanned
whole; offsets count code points and ends are exclusive.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellarline.llm.common import doc_texts, map_batches

#: Kinds in the order in which spans with the same start are listed.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "key", "jwt")

# The patterns of the base findings and the least lengths of what they find.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24
# A run is taken to its end, so asking for the least length in the pattern finds the same runs as dropping short ones.
ACCESS = re.compile(r"AKIA[A-Z0-9]{%d,}" % (ACCESS_LENGTH - 4))
HEX = re.compile(r"[0-9a-f]{%d,}" % HEX_LENGTH)

WORDS_OF_ASSIGN = ("passw", "secret", "token", "api")
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")
LINE_END = re.compile(r"\\r|\\n|\s*\n")  # also as it is written inside a string of JSON or source code
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){30,}(?![0-9A-Fa-f])")
JWT = re.compile(r"(?<![A-Za-z0-9_.-])(ey[A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")

OPENSSH_MAGIC = b"openssh-key-v1\0"
# How the object identifiers of password-based encryption (PKCS#5, PKCS#12) begin.
PASSWORD_BASED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
INTEGER, BIT_STRING, OCTET_STRING, OBJECT_ID, SEQUENCE = 0x02, 0x03, 0x04, 0x06, 0x30


def from_base64(text: str) -> bytes | None:
    """The bytes of standard or URL-safe base64 with or without padding, or None."""
    body = "".join(text.split()).rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of consecutive DER values that fill ``data`` exactly, or None."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, length = data[at], data[at + 1]
        at += 2
        if length & 0x80:
            n = length & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            length = int.from_bytes(data[at : at + n], "big")
            if length < 0x80 or data[at] == 0:
                return None
            at += n
        if at + length > len(data):
            return None
        items.append((tag, data[at : at + length]))
        at += length
    return items


def is_der_private_key(data: bytes) -> bool:
    """A DER sequence with nested lengths that add up, shaped as an RSA, DSA, EC or PKCS#8 private key, plain or encrypted."""
    outer = der_items(data)
    if not outer or len(outer) != 1 or outer[0][0] != SEQUENCE:
        return False
    parts = der_items(outer[0][1])
    if not parts:
        return False
    tags = [tag for tag, _ in parts]
    if tags == [SEQUENCE, OCTET_STRING]:
        algorithm = der_items(parts[0][1])
        return bool(algorithm) and algorithm[0][0] == OBJECT_ID and algorithm[0][1].startswith(PASSWORD_BASED) and len(parts[1][1]) >= 16
    if parts[0][0] != INTEGER or len(parts[0][1]) != 1:
        return False
    if tags == [INTEGER] * 6 and parts[0][1] == b"\0":
        # DSA: version, the primes p and q, generator, public and private number.
        return len(parts[1][1]) >= 64 and 16 <= len(parts[2][1]) <= 40 and all(len(content) for _, content in parts)
    if len(parts) >= 9 and tags[:9] == [INTEGER] * 9 and parts[0][1] in (b"\0", b"\1"):
        return all(len(content) for _, content in parts)
    if tags[:2] == [INTEGER, OCTET_STRING] and parts[0][1] == b"\1":
        return 16 <= len(parts[1][1]) <= 80 and all(der_items(c) for t, c in parts[2:] if t in (0xA0, 0xA1))
    if tags[:3] == [INTEGER, SEQUENCE, OCTET_STRING] and parts[0][1] in (b"\0", b"\1"):
        algorithm = der_items(parts[1][1])
        return bool(algorithm) and algorithm[0][0] == OBJECT_ID and bool(der_items(parts[2][1]))
    return False


def is_openssh_key(data: bytes) -> bool:
    """The OpenSSH container: magic, then cipher, key derivation, options, keys, private part by their lengths."""
    if not data.startswith(OPENSSH_MAGIC):
        return False
    at, fields = len(OPENSSH_MAGIC), []
    while len(fields) < 3:
        if at + 4 > len(data):
            return False
        end = at + 4 + int.from_bytes(data[at : at + 4], "big")
        if end > len(data):
            return False
        fields.append(data[at + 4 : end])
        at = end
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if not 1 <= keys <= 16 or not fields[0].isascii() or not fields[1].isascii():
        return False
    for _ in range(keys + 1):
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at == len(data)


def is_key(data: bytes | None) -> bool:
    return data is not None and (is_der_private_key(data) or is_openssh_key(data))


def pem_key(body: str) -> bool:
    """Whether the text between the two PEM lines is a key: a key encoding, or what its header lines say is encrypted.

    An encrypted body has no structure of its own; it must be whole blocks of the cipher, as long as the initial vector
    in ``DEK-Info``.
    """
    lines, headers = [line.strip() for line in LINE_END.sub("\n", body).split("\n")], {}
    while lines and (not lines[0] or ":" in lines[0]):
        name, _, value = lines.pop(0).partition(":")
        headers[name] = value.strip()
    data = from_base64("".join(lines))
    if not headers.get("Proc-Type", "").endswith("ENCRYPTED"):
        return is_key(data)
    _, _, vector = headers.get("DEK-Info", "").partition(",")
    if not re.fullmatch("(?:[0-9A-Fa-f]{2}){8}|(?:[0-9A-Fa-f]{2}){16}", vector):
        return False
    return bool(data) and len(data) >= 32 and len(data) % (len(vector) // 2) == 0


def pem_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of the PEM blocks of private keys; the next dashes behind a first line must be its last line."""
    found = []
    for m in PEM.finditer(text):
        last, begin = f"-----END {m[1]}-----", text.find("-----", m.end())
        if begin >= 0 and text.startswith(last, begin) and pem_key(text[m.end() : begin]):
            found.append((m.start(), begin + len(last)))
    return found


def is_token_header(text: str) -> bool:
    """Base64 of a JSON object that names a signing algorithm."""
    data = from_base64(text)
    try:
        header = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def find_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) of every finding, in the order in which they are listed."""
    if not text:
        return []
    spans: list[tuple[int, int, int]] = []
    lower = text.lower()
    if any(word in lower for word in WORDS_OF_ASSIGN):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_VALUE]
    # All further runs hold no blank, so a text without a long word has none; PEM blocks are announced by a line.
    if max(map(len, text.split()), default=0) >= ACCESS_LENGTH:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        spans += [(m.start(), 4, m.end()) for m in BASE64.finditer(text) if is_key(from_base64(m[0]))]
        spans += [(m.start(), 4, m.end()) for m in HEX_KEY.finditer(text) if is_key(bytes.fromhex(m[0]))]
        spans += [(m.start(), 5, m.end()) for m in JWT.finditer(text) if is_token_header(m[1])]
    if "PRIVATE KEY-----" in text:
        spans += [(start, 3, end) for start, end in pem_spans(text)]
    return sorted(set(spans))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``spans`` (array of kind, start, end in listed order) of each row of ``docs``."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [
            [{"kind": KINDS[kind], "start": start, "end": end} for start, kind, end in find_spans(text)]
            for text in batch.column("text").to_pylist()
        ]
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(span))], ["id", "spans"])

    texts = doc_texts(docs, id_col, text_col)
    id_type = texts.schema["id"].dataType.simpleString()
    return map_batches(texts, step, f"id {id_type}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def secret_digest(docs: DataFrame) -> DataFrame:
    """Counts of the base findings, their digest, and all spans per document."""
    found = secret_spans(docs)
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        F.col("id").alias("doc_id"),
        *[of(kind) for kind in BASE_KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
