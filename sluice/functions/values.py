"""Column functions: accessors with defaults, partition numbers, load, backoff, restart rules, display and frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Message types of the frame format.
MESSAGE_TYPES = {1: "send", 2: "monitor", 3: "demonitor", 4: "link", 5: "unlink", 6: "exit", 7: "process_down", 8: "name_lookup", 9: "name_register", 10: "name_unregister", 11: "heartbeat", 12: "heartbeat_ack", 13: "node_info"}


def variant_long(json: Column, path: str, default: int = 0) -> Column:
    """A number inside a dynamic value; a missing or differently typed one becomes the default."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(json), path, "bigint"), F.lit(default).cast("bigint"))


def variant_text(json: Column, path: str, default: str | None = None) -> Column:
    """A string inside a dynamic value; a missing or differently typed one becomes the default."""
    value = F.try_parse_json(json)
    held = F.try_variant_get(value, path, "string")
    return F.coalesce(F.when(F.schema_of_variant(F.try_variant_get(value, path, "variant")) == "STRING", held), F.lit(default))


def new_tag() -> Column:
    """A random tag (UUID version 4) for a registration."""
    return F.uuid()


def clock_ms(at: Column | None = None) -> Column:
    """Milliseconds since 1970 of a time in UTC, or of the query's start."""
    return F.unix_millis(F.current_timestamp() if at is None else at.cast("timestamp"))


def ms_text(ms: Column) -> Column:
    """Milliseconds as text: three decimals below 1, two below 100, then none; N/A for a null."""
    return F.when(ms < 1, F.format_string("%.3fms", ms)).when(ms < 100, F.format_string("%.2fms", ms)).when(ms.isNotNull(), F.format_string("%.0fms", ms)).otherwise("N/A")


def pid_text(node: Column, local: Column) -> Column:
    return F.format_string("<%d.%d>", node, local)


def partition_mod(key: Column, n: int) -> Column:
    return F.pmod(key, F.lit(n)).cast("long")


def partition_hash(key: Column, n: int) -> Column:
    """The first 32 bits of the key's md5, modulo n: the same on every engine that has md5."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("long")


def load_score(in_flight: Column, avg_us: Column) -> Column:
    return (in_flight + 1) * F.greatest(avg_us, F.lit(1))


def backoff_ms(attempt: Column, base: int = 1000, most: int = 30_000) -> Column:
    """base * 2^attempt, at most ``most``; the exponent is clamped, so late attempts don't wrap to zero."""
    return F.least(F.lit(base).cast("long") * F.expr("1L") * F.pow(F.lit(2.0), F.least(attempt, F.lit(30))).cast("long"), F.lit(most).cast("long"))


def should_restart(kind: Column, reason: Column) -> Column:
    """permanent: always; transient: after an abnormal exit; temporary: never."""
    normal = reason.isin("normal", "shutdown")
    return F.when(kind == "permanent", True).when(kind == "transient", ~normal).otherwise(False)


def big_endian(value: Column, width: int) -> Column:
    """An unsigned number as width bytes."""
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * width, "0"))


def frame(version: Column, kind: Column, request: Column, header: Column, payload: Column) -> Column:
    """version u8, type u8, request u64, header length u32, payload length u32, header, payload (all big-endian)."""
    return F.concat(big_endian(version, 1), big_endian(kind, 1), big_endian(request, 8), big_endian(F.length(header), 4), big_endian(F.length(payload), 4), header, payload)


def unframed(data: Column) -> Column:
    """The fields of a frame as a struct; null if data is shorter than its header says or the type is unknown."""

    def number(at: int, width: int) -> Column:
        return F.conv(F.hex(F.substring(data, at, width)), 16, 10).cast("long")

    head, body = number(11, 4), number(15, 4)
    kind = number(2, 1)
    whole = (F.length(data) >= 18) & (F.length(data) >= 18 + head + body) & kind.isin(*MESSAGE_TYPES)
    names = F.create_map(*[F.lit(x) for pair in MESSAGE_TYPES.items() for x in pair])
    fields = F.struct(number(1, 1).alias("version"), F.try_element_at(names, kind.cast("int")).alias("kind"), number(3, 8).alias("request"), F.substr(data, F.lit(19), head.cast("int")).alias("header"), F.substr(data, (19 + head).cast("int"), body.cast("int")).alias("payload"))
    return F.when(whole, fields)


def fingerprint(data: Column) -> Column:
    return F.sha2(data, 256)
