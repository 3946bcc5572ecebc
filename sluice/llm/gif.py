"""Media columns: GIF files in a binary column, encoded from samples and decoded to timed frames.

``encode_samples`` stores a payload as the 8-bit samples of an animated GIF (64 samples a row, up to 256 rows a frame, a
grey palette, LZW code streams). ``decode`` reads any GIF87a/89a: LZW streams of every code size with deferred clears,
global and local palettes, interlacing, transparency, disposal 0 to 3 and frame delays; each frame is composed on the
canvas and summed into a colour histogram of 64 bins (two bits a channel) and a count of transparent pixels.

Both are maps over rows with no shuffle; the encoded table is written once to the shared folder and read back. Null and
empty texts are the payload of 64 zero bytes; equal texts give equal files. A file that cannot be decoded gives its
reason in ``error`` and no frames, as does a canvas of more than ``CANVAS`` pixels (a parameter): a header of a few bytes
may ask for 16 GB. Null media give neither. Texts of any length are stored and read whole, one at a time where they are
long; columns of a media table that are named like a result are replaced. Repeated rows are handled row by row; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.grid import sliced
from sluice.llm.store import written

WIDTH, ROWS, DELAY_CS, FULL = 64, 256, 4, 4096
#: Pixels of the largest canvas (4 bytes each) that is composed.
CANVAS = 1 << 24
GREY = bytes(v for v in range(256) for _ in range(3))
FRAME = pa.struct([("no", pa.int32()), ("left", pa.int32()), ("top", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int32()), ("disposal", pa.int32()), ("transparent", pa.int64()), ("histogram", pa.list_(pa.int64()))])
FRAMES = "array<struct<no:int,left:int,top:int,width:int,height:int,start_ms:long,delay_ms:int,disposal:int,transparent:long,histogram:array<long>>>"


def widths(size: int) -> np.ndarray:
    """Bits of the j-th code after a clear, for codes that start at size + 1 bits."""
    top = (1 << size) + 1 + np.arange(FULL)
    return np.clip(np.floor(np.log2(top)).astype(np.int64) + 1, size + 1, 12)


WIDTHS = {size: widths(size) for size in range(2, 9)}
OFFSETS = {size: np.concatenate([[0], np.cumsum(w)]) for size, w in WIDTHS.items()}


def lzw_codes(samples: bytes) -> list[int]:
    """Codes of 8-bit samples: clear first, clear again when the table is full, then the end code."""
    codes, known, free = [256], {}, 258
    get, put = known.get, codes.append
    rest = iter(samples)
    held = next(rest)
    for sample in rest:
        key = held << 8 | sample
        longer = get(key)
        if longer is not None:
            held = longer
            continue
        put(held)
        known[key] = free
        free += 1
        held = sample
        if free == FULL:
            put(256)
            known.clear()
            free = 258
    codes += (held, 257)
    return codes


def packed(codes: list[int], size: int = 8) -> bytes:
    c = np.array(codes, np.int64)
    clears = np.flatnonzero(c == 1 << size)
    begin = np.concatenate([[0], clears + 1])
    since = np.arange(len(c)) - begin[np.searchsorted(clears, np.arange(len(c)), side="left")]
    bits = np.arange(12)
    return np.packbits(((c[:, None] >> bits) & 1).astype(np.uint8)[bits < WIDTHS[size][since][:, None]], bitorder="little").tobytes()


def unpacked(data: bytes, size: int) -> Iterator[list[int]]:
    """The codes between clears, an inner list for each clear, up to the end code or the end of data."""
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    window = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    clear, at, total = 1 << size, 0, 8 * len(data)
    while at < total:
        segment: list[int] = []
        j = 0
        while True:
            left = total - at
            if j == 0:
                offset, width = OFFSETS[size][:-1], WIDTHS[size]
            else:  # the table is full and no clear has come: 12 bits from here on
                offset, width = 12 * np.arange(FULL), np.full(FULL, 12)
            n = int(np.searchsorted(offset + width, left, side="right"))
            place = at + offset[:n]
            codes = window[place >> 3] >> (place & 7) & (1 << width[:n]) - 1
            stop = np.flatnonzero((codes == clear) | (codes == clear + 1))
            if len(stop):
                segment += codes[: stop[0]].tolist()
                yield segment
                if codes[stop[0]] == clear + 1:
                    return
                at = int(place[stop[0]] + width[stop[0]])
                break
            segment += codes.tolist()
            if n < FULL:
                yield segment
                return
            at, j = int(place[-1] + width[n - 1]), j + n


def lzw_samples(data: bytes, size: int, most: int = 1 << 62) -> bytes:
    """The samples of a code stream; it is read no further than some thousand codes after ``most`` samples."""
    out: list[bytes] = []
    put, made, counted = out.append, 0, 0
    singles = [bytes([v]) for v in range(1 << size)] + [b"", b""]
    for codes in unpacked(data, size):
        if not codes:
            continue
        if codes[0] >= 1 << size:
            raise ValueError("first code is no sample")
        table = singles.copy()
        add, free = table.append, len(table)
        before = table[codes[0]]
        put(before)
        for at in range(1, len(codes), FULL):
            for code in codes[at : at + FULL]:
                if code < free:
                    entry = table[code]
                elif code == free and free < FULL:
                    entry = before + before[:1]
                else:
                    raise ValueError("code beyond the table")
                put(entry)
                if free < FULL:
                    add(before + entry[:1])
                    free += 1
                before = entry
            made += sum(map(len, out[counted:]))
            counted = len(out)
            if made >= most:
                return b"".join(out)
    return b"".join(out)


def blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def padded(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % WIDTH or (0 if text else WIDTH))


def encode_samples(payload: bytes) -> bytes:
    """payload: a positive multiple of WIDTH bytes."""
    frame = WIDTH * ROWS
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(ROWS, len(payload) // WIDTH), 0xF7, 0, 0), GREY]
    for at in range(0, len(payload), frame):
        part = payload[at : at + frame]
        out += [b"\x21\xf9\x04\x04", struct.pack("<HB", DELAY_CS, 0), b"\0", b"\x2c", struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0), b"\x08", blocks(packed(lzw_codes(part)))]
    return b"".join([*out, b"\x3b"])


class Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        part = self.data[self.at : self.at + n]
        if len(part) < n:
            raise ValueError("file ends early")
        self.at += n
        return part

    def chain(self) -> bytes:
        out = []
        while n := self.take(1)[0]:
            out.append(self.take(n))
        return b"".join(out)


def palette(raw: bytes) -> np.ndarray:
    table = np.zeros((256, 4), np.uint8)
    table[: len(raw) // 3, :3] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
    table[:, 3] = 255
    return table


def decode(data: bytes, most: int = CANVAS) -> tuple[list[dict], bytes]:
    """Frames as composed on a canvas of at most ``most`` pixels, with times and histograms, and the samples of all frames in file order."""
    r = Reader(data)
    if r.take(6) not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF signature")
    width, height, flags, _, _ = struct.unpack("<HHBBB", r.take(7))
    shared = palette(r.take(3 << (flags & 7) + 1)) if flags & 0x80 else palette(GREY)
    if width * height > most:
        raise ValueError("canvas too large")
    canvas = np.zeros((height, width, 4), np.uint8)
    frames: list[dict] = []
    samples: list[bytes] = []
    disposal = delay = clock = 0
    clear_index = None
    while (kind := r.take(1)[0]) != 0x3B:
        if kind == 0x21:
            label, body = r.take(1)[0], r.chain()
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, 10 * int.from_bytes(body[1:3], "little")
                clear_index = body[3] if body[0] & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError("unknown block")
        left, top, w, h, flags = struct.unpack("<HHHHB", r.take(9))
        colours = palette(r.take(3 << (flags & 7) + 1)) if flags & 0x80 else shared
        size = r.take(1)[0]
        if size not in WIDTHS:
            raise ValueError("bad code size")
        if w * h > most:
            raise ValueError("frame too large")
        own = lzw_samples(r.chain(), size, w * h)[: w * h]
        if len(own) < w * h:
            raise ValueError("too few samples")
        index = np.frombuffer(own, np.uint8).reshape(h, w)
        if flags & 0x40:
            order = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
            straight = np.empty_like(index)
            straight[order] = index
            index = straight
        samples.append(index.tobytes())
        saved = canvas.copy() if disposal == 3 else None
        area = canvas[top : top + h, left : left + w]
        shown = index[: area.shape[0], : area.shape[1]]
        seen = np.ones(shown.shape, bool) if clear_index is None else shown != clear_index
        area[seen] = colours[shown[seen]]
        solid = canvas[canvas[:, :, 3] > 0].astype(np.int64) >> 6
        histogram = np.bincount(solid[:, 0] * 16 + solid[:, 1] * 4 + solid[:, 2], minlength=64)
        frames.append({"no": len(frames), "left": left, "top": top, "width": w, "height": h, "start_ms": clock, "delay_ms": delay, "disposal": disposal, "transparent": height * width - len(solid), "histogram": histogram.tolist()})
        clock += delay
        if disposal == 2:
            area[:] = 0
        elif disposal == 3:
            canvas = saved
        disposal, delay, clear_index = 0, 0, None
    return frames, b"".join(samples)


def encode_texts(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_bytes (of the text) and media, the GIF of its padded UTF-8 bytes."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            media = [encode_samples(padded(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(encoded, "doc_id long, n_bytes long, media binary")


def decode_media(media: DataFrame, most: int = CANVAS) -> DataFrame:
    """All columns of media (one of them the binary ``media``) and, per row, frames, samples (binary) and error."""
    media = media.drop(*[c for c in media.columns if c.lower() in ("frames", "samples", "error")])
    schema = media.select("*", F.array().cast(FRAMES).alias("frames"), F.lit(b"").alias("samples"), F.lit("").alias("error")).schema
    for field in schema.fields[-3:]:
        field.nullable = True

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "media"):
            frames, samples, errors = [], [], []
            for data in batch.column("media").to_pylist():
                found, raw, error = None, None, None
                try:
                    found, raw = decode(data, most) if data is not None else (None, None)
                except (ValueError, struct.error, IndexError) as e:
                    error = str(e)
                frames.append(found)
                samples.append(raw)
                errors.append(error)
            kept = [batch.column(k) for k in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(frames, pa.list_(FRAME)), pa.array(samples, pa.binary()), pa.array(errors, pa.string())], names=[*batch.schema.names, "frames", "samples", "error"])

    return media.mapInArrow(decoded, schema)


def timed_frames(decoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per frame of decode_media's result, keyed by key."""
    return decoded.select(key, F.explode("frames").alias("f")).select(key, "f.*")


def report(docs: DataFrame) -> DataFrame:
    """Encode, store, read back and decode every text; the digests of what was read."""
    stored = written(encode_texts(docs), "gif")
    d = decode_media(stored)
    histogram = F.aggregate("frames", F.array_repeat(F.lit(0).cast("long"), 64), lambda acc, f: F.zip_with(acc, f["histogram"], lambda a, b: a + b))
    last = F.element_at("frames", -1)
    feature = F.concat_ws(";", F.concat(F.lit("frames="), F.size("frames").cast("string")), F.concat(F.lit("ms="), (last["start_ms"] + last["delay_ms"]).cast("string")), F.concat(F.lit("rows="), last["height"].cast("string")), F.concat(F.lit("hist="), F.array_join(F.filter(histogram, lambda x: x > 0).cast("array<string>"), ",")))
    return d.select(
        "doc_id", "n_bytes", F.length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"), F.crc32(F.expr("substring(samples, -64, 64)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )
