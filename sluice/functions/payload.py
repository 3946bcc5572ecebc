"""Dynamic payloads: MessagePack bytes to JSON text (for VARIANT), in Arrow batches.

Integers beyond 64 signed bits, and everything else JSON has no form for, become text: binary as hex digits, extensions
as an object of type and hex digits. Map keys that are not text are written as their JSON. Damaged or trailing bytes give
null.
"""

from __future__ import annotations

import json
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Type bytes of the MessagePack format and the struct codes of their numbers or lengths.
NUMBERS = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
SIZED = {0xC4: ("bin", ">B"), 0xC5: ("bin", ">H"), 0xC6: ("bin", ">I"), 0xC7: ("ext", ">B"), 0xC8: ("ext", ">H"), 0xC9: ("ext", ">I"), 0xD9: ("str", ">B"), 0xDA: ("str", ">H"), 0xDB: ("str", ">I"), 0xDC: ("array", ">H"), 0xDD: ("array", ">I"), 0xDE: ("map", ">H"), 0xDF: ("map", ">I")}
PLAIN = {0xC0: None, 0xC2: False, 0xC3: True}


class Unpacker:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n > len(self.data) - self.at:
            raise ValueError("payload ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, code: str):
        return struct.unpack(code, self.take(struct.calcsize(code)))[0]

    def value(self):
        b = self.take(1)[0]
        if b in PLAIN:
            return PLAIN[b]
        if b in NUMBERS:
            return self.number(NUMBERS[b])
        if b in SIZED:
            kind, code = SIZED[b]
            return self.sized(kind, self.number(code))
        if b < 0x80:
            return b
        if b >= 0xE0:
            return b - 256
        if b < 0x90:
            return self.sized("map", b & 15)
        if b < 0xA0:
            return self.sized("array", b & 15)
        if b < 0xC0:
            return self.sized("str", b & 31)
        if 0xD4 <= b <= 0xD8:
            return self.sized("ext", 1 << (b - 0xD4))
        raise ValueError("unknown type")

    def sized(self, kind: str, n: int):
        if kind == "str":
            return self.take(n).decode()
        if kind == "bin":
            return self.take(n).hex()
        if kind == "ext":
            return {"type": self.number(">b"), "data": self.take(n).hex()}
        if kind == "array":
            return [self.value() for _ in range(n)]
        pairs = [(self.value(), self.value()) for _ in range(n)]
        return {k if isinstance(k, str) else json.dumps(k): v for k, v in pairs}


def to_json(data: bytes | None) -> str | None:
    if data is None:
        return None
    try:
        u = Unpacker(data)
        value = u.value()
        return json.dumps(value, ensure_ascii=False, allow_nan=False) if u.at == len(data) else None
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(StringType())
def _converted(s: pd.Series) -> pd.Series:
    return s.map(to_json)


def message_json(data: Column) -> Column:
    """MessagePack bytes as JSON text; parse_json of it is the payload as VARIANT."""
    return _converted(data)
