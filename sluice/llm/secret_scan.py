"""Secret scan with structural confirmation.

Base kinds are found by pattern: ``assign`` (a key word, a sign, a value of 6 or more characters), ``access`` (AKIA...,
20 or more characters) and ``hex`` (24 or more digits). The method adds spans that only a decoder can confirm:

- ``token``: three base64url parts, of which the first decodes to a JSON object naming a signature algorithm (white space
  before and in it allowed) and the second to a JSON object;
- ``pem``: a BEGIN/END PRIVATE KEY block whose body decodes to a key encoding, or is marked as encrypted and has whole
  cipher blocks;
- ``key``: a key encoding in base64 or hex, anywhere in a run of such characters, also wrapped over lines.

A key encoding is DER whose nested lengths all fit and whose fields are those of a private key (RSA: the primes divide
the modulus; DSA: the public value is the generator's power; EC: private octets and tagged rest; PKCS#8: what its
algorithm says; encrypted PKCS#8: a password scheme and whole octets), or the OpenSSH container with its nested public
and private parts. Where a key ends is what its own lengths say.

Scanning is a map over whole texts with no shuffle and takes linear time but for decoding: every place that could open a
key is decoded at most ``LONGEST`` bytes far. Null and empty texts have no spans; repeated rows are scanned row by row;
an empty table gives an empty result; texts of any length are scanned whole; further columns are kept by redact and
ignored by the rest. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.grid import sliced

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
HINTS = ("passw", "secret", "token", "api")
#: A token's header opens with { or white space, which leaves these first two characters.
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(?:e[w-z0-9_-]|I[A-P]|C[Q-Za-v]|D[Q-Za-f])[A-Za-z0-9_-]{11,}+\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++")
MARKER = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{0,40}?)PRIVATE KEY-----")
BREAK = re.compile(r"\r?\n[\x20\t]*|\\n")
RUN = re.compile(r"[A-Za-z0-9+/_-]{40,}+(?:(?:\r?\n[\x20\t]*+|\\n)[A-Za-z0-9+/_-]{4,}+)*={0,2}")
#: Where base64 may open a DER sequence or the OpenSSH container, and hex a sequence with a version or the container.
OPENS = re.compile(r"(?=M[A-P]|b3BlbnNzaC1rZXktdjEA)")
OPENS_HEX = re.compile(r"(?i)(?=30(?:82[0-9a-f]{4}|81[0-9a-f]{2}|[2-7][0-9a-f])(?:0201|30)|6f70656e7373682d6b65792d763100)")
HEX_RUN = re.compile(r"[0-9a-fA-F]{80,}")
LONGEST = 1 << 14
#: Object identifiers (DER content) of key algorithms and of password schemes.
RSA, EC, DSA = bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a8648ce3d0201"), bytes.fromhex("2a8648ce380401")
CURVES = {bytes.fromhex("2b656e"): 32, bytes.fromhex("2b656f"): 56, bytes.fromhex("2b6570"): 32, bytes.fromhex("2b6571"): 57}
PASSWORD = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "token", "pem", "key")
SPAN = "struct<kind:string,start:int,end:int>"


def unbase64(text: str) -> bytes | None:
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tag and content of each element if the lengths fill data exactly, else None."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            wide = size & 0x7F
            if not 1 <= wide <= 4 or at + wide > len(data):
                return None
            size, at = int.from_bytes(data[at : at + wide], "big"), at + wide
        if at + size > len(data):
            return None
        items.append((tag, data[at : at + size]))
        at += size
    return items


def numbers(items: list[tuple[int, bytes]], n: int) -> list[int] | None:
    """The first n items as positive integers (the version, before them, may be zero)."""
    if len(items) < n or any(tag != 0x02 or not body for tag, body in items[:n]):
        return None
    values = [int.from_bytes(body, "big", signed=True) for _, body in items[:n]]
    return values if values[0] in (0, 1) and min(values[1:]) > 0 else None


def is_rsa(items: list[tuple[int, bytes]]) -> bool:
    """Version, modulus, exponents, primes and what is derived from them."""
    v = numbers(items, 9)
    return v is not None and v[1].bit_length() >= 256 and min(v[4], v[5]) > 1 and v[2] > 1 and v[3] > 1 and v[1] % (v[4] * v[5]) == 0


def is_dsa(items: list[tuple[int, bytes]]) -> bool:
    v = numbers(items, 6)
    return v is not None and len(items) == 6 and 256 <= v[1].bit_length() <= 4096 and v[5] < v[2] < v[1] and pow(v[3], v[5], v[1]) == v[4]


def is_ec(items: list[tuple[int, bytes]]) -> bool:
    """Version 1, the private octets, then curve and public point at most."""
    return len(items) >= 2 and items[0] == (0x02, b"\1") and items[1][0] == 0x04 and 16 <= len(items[1][1]) <= 72 and any(items[1][1]) and all(t in (0xA0, 0xA1) and der_items(c) for t, c in items[2:])


def is_pkcs8(items: list[tuple[int, bytes]]) -> bool:
    if len(items) < 3 or items[0] not in ((0x02, b"\0"), (0x02, b"\1")) or items[1][0] != 0x30 or items[2][0] != 0x04 or any(t not in (0xA0, 0xA1, 0x81) for t, _ in items[3:]):
        return False
    algorithm, key = der_items(items[1][1]), items[2][1]
    if not algorithm or algorithm[0][0] != 0x06:
        return False
    name, inner = algorithm[0][1], der_items(key)
    if name in CURVES:
        return inner is not None and len(inner) == 1 and inner[0][0] == 0x04 and len(inner[0][1]) == CURVES[name]
    if name == DSA:
        return inner is not None and len(inner) == 1 and inner[0][0] == 0x02 and int.from_bytes(inner[0][1], "big") > 1
    fields = der_items(inner[0][1]) if inner and len(inner) == 1 and inner[0][0] == 0x30 else None
    if name in (RSA, EC):
        return bool(fields) and (is_rsa(fields) if name == RSA else is_ec(fields))
    return len(key) >= 16 and inner is not None


def is_encrypted(items: list[tuple[int, bytes]]) -> bool:
    """PKCS#8 under a password: the scheme with its parameters, and octets."""
    if len(items) != 2 or items[0][0] != 0x30 or items[1][0] != 0x04 or len(items[1][1]) < 16:
        return False
    scheme = der_items(items[0][1])
    return bool(scheme) and len(scheme) == 2 and scheme[0][0] == 0x06 and scheme[0][1].startswith(PASSWORD) and scheme[1][0] == 0x30 and bool(der_items(scheme[1][1]))


def is_der_key(data: bytes) -> bool:
    top = der_items(data)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    items = der_items(top[0][1])
    return bool(items) and any(f(items) for f in (is_rsa, is_ec, is_pkcs8, is_encrypted, is_dsa))


MAGIC = b"openssh-key-v1\0"


def openssh_size(data: bytes) -> int:
    """Bytes of the OpenSSH container at the start of data, 0 if it is none: cipher, derivation, its options, the number
    of keys, the public keys, and a private part that, in clear, opens with two equal numbers and the public key's type."""
    if not data.startswith(MAGIC):
        return 0
    at = len(MAGIC)

    def string() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        at += 4 + size
        return data[at - size : at]

    def kind(part: bytes) -> bytes:
        return part[4 : 4 + int.from_bytes(part[:4], "big")]

    cipher, derivation, options = string(), string(), string()
    if None in (cipher, derivation, options) or at + 4 > len(data):
        return 0
    n, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    public = [string() for _ in range(n)] if 1 <= n <= 16 else [None]
    private = string()
    if None in public or private is None or not all(re.fullmatch(rb"[a-z0-9@.-]{4,64}", kind(p)) for p in public):
        return 0
    if cipher == b"none":
        clear = len(private) >= 16 and private[:4] == private[4:8] and kind(private[8:]) == kind(public[0])
        return at if clear else 0
    return at if derivation not in (b"none", b"") and len(private) >= 16 and len(private) % 8 == 0 else 0


def der_size(data: bytes) -> int:
    """Bytes of the DER element at the start of data, as its length says; 0 if the length is not read."""
    wide = data[1] & 0x7F if len(data) > 1 and data[1] & 0x80 else 0
    if len(data) < 2 + wide or wide > 2:
        return 0
    return 2 + wide + int.from_bytes(data[2 : 2 + wide], "big") if wide else 2 + data[1]


def key_size(head: bytes, rest) -> int:
    """Bytes of the key that opens with head (some 12 bytes); rest(n) decodes n bytes from there, or fewer at the end."""
    if head.startswith(MAGIC[: len(head)]):
        return openssh_size(rest(LONGEST))
    size = der_size(head)
    if not 40 <= size <= LONGEST or head[:1] != b"\x30":
        return 0
    body = 2 + (head[1] & 0x7F if head[1] & 0x80 else 0)
    if head[body : body + 1] not in (b"\x02", b"\x30") or head[body] == 0x02 and head[body + 1 : body + 3] not in (b"\1\0", b"\1\1"):
        return 0
    data = rest(size)
    return size if len(data) == size and is_der_key(data) else 0


def is_key(data: bytes | None) -> bool:
    return bool(data) and (is_der_key(data) or openssh_size(data) == len(data))


def is_signed_token(text: str) -> bool:
    head, body, _ = text.split(".")
    try:
        header = json.loads(unbase64(head) or b"")
        claims = json.loads(unbase64(body) or b"") if isinstance(header, dict) and isinstance(header.get("alg"), str) else None
    except (ValueError, RecursionError):
        return False
    return isinstance(claims, dict)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def token_spans(text: str) -> list[tuple[str, int, int]]:
    out, at = [], 0
    while m := TOKEN.search(text, at):
        good = is_signed_token(m[0])
        if good:
            out.append(("token", m.start(), m.end()))
        at = m.end() if good else text.index(".", m.start())  # a later part may begin a true token
    return out


def pem_spans(text: str) -> list[tuple[str, int, int]]:
    """Blocks between a BEGIN marker and the very next marker, its END."""
    out, open_ = [], None
    for m in MARKER.finditer(text):
        if m[1] == "BEGIN":
            open_ = m
        elif open_ is not None:
            if m[2] == open_[2] and is_block(text[open_.end() : m.start()]):
                out.append(("pem", open_.start(), m.end()))
            open_ = None
    return out


def is_block(body: str) -> bool:
    lines = [line.strip() for line in body.replace("\\r", "").replace("\\n", "\n").split("\n")]
    data = unbase64("".join(line for line in lines if ":" not in line))
    if any(line.startswith("DEK-Info:") for line in lines):
        return bool(data) and len(data) % 8 == 0
    return is_key(data)


def run_spans(text: str) -> list[tuple[str, int, int]]:
    """Keys within runs of base64 characters (line breaks between them left out) and of hex digits."""
    out = []
    for m in RUN.finditer(text):
        run, places, begins = m[0], [], []
        at = length = 0
        parts = []
        for gap in [*BREAK.finditer(run), None]:
            part = run[at : gap.start() if gap else len(run)]
            begins.append(length)
            places.append(m.start() + at)
            parts.append(part)
            length += len(part)
            at = gap.end() if gap else at
        compact = "".join(parts)

        def original(k: int, begins=begins, places=places) -> int:
            j = bisect_right(begins, k) - 1
            return places[j] + k - begins[j]

        after = 0
        for o in OPENS.finditer(compact):
            k = o.start()
            if k < after:
                continue
            size = key_size(unbase64(compact[k : k + 16].rstrip("=")) or b"", lambda n, k=k, c=compact: unbase64_part(c, k, n))
            if size:
                after = k + -(-size * 4 // 3)
                last = original(after - 1) + 1
                out.append(("key", original(k), last + len(re.match("={0,2}", text[last : last + 2])[0])))
    for m in HEX_RUN.finditer(text):
        run, after = m[0], 0
        for o in OPENS_HEX.finditer(run):
            k = o.start()
            if k < after:
                continue
            size = key_size(bytes.fromhex(run[k : k + 24]), lambda n, k=k, r=run: bytes.fromhex(r[k : k + min(2 * n, (len(r) - k) // 2 * 2)]))
            if size:
                after = k + 2 * size
                out.append(("key", m.start() + k, m.start() + after))
    return out


def unbase64_part(run: str, at: int, n: int) -> bytes:
    """n bytes of the base64 that opens at ``at``, or those up to its end."""
    part = run[at : at + -(-n * 4 // 3)].rstrip("=")
    return (unbase64(part[: len(part) - (len(part) % 4 == 1)]) or b"")[:n]


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    out = token_spans(text) if text.count(".") > 1 else []
    blocks = pem_spans(text) if "PRIVATE KEY-----" in text else []
    ends = [b for _, _, b in blocks]
    for kind, a, b in run_spans(text):
        k = bisect_right(ends, a)
        if k == len(blocks) or blocks[k][1] >= b:
            out.append((kind, a, b))
    return out + blocks


def spans_of(text: str | None) -> list[tuple[str, int, int]]:
    """All spans by start, then kind as listed in KINDS, then end."""
    found = set(base_spans(text) + confirmed_spans(text)) if text else ()
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id and spans, an array of (kind, start, end)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in sliced(batches, "text"):
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in spans_of(t)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, f"doc_id long, spans array<{SPAN}>")


def redacted(text: str | None, mark: str) -> str | None:
    keep, at = [], 0
    for _, a, b in spans_of(text):
        if a >= at:
            keep += [text[at:a], mark]
        at = max(at, b)
    return "".join(keep) + text[at:] if keep else text


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of its texts replaced by mark (overlapping spans by one); columns as given."""
    place = docs.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            columns = [batch.column(k) for k in range(batch.num_columns)]
            columns[place] = pa.array([redacted(t, mark) for t in columns[place].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(scan, docs.schema)


def report(docs: DataFrame) -> DataFrame:
    """The digest of find_secrets: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return find_secrets(docs).select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
