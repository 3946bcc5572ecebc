import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from sluice.llm import gif as G


def stream(codes, size):
    """Codes packed bit by bit; widths found by running the decoder's rule."""
    bits, clear, free, width, first = [], 1 << size, 0, size + 1, True
    for c in codes:
        bits += [c >> k & 1 for k in range(width)]
        if c == clear:
            free, width, first = clear + 2, size + 1, True
        elif first:
            first = False
        elif free < 4096:
            free += 1
            width = min(12, width + (free == 1 << width))
    bits += [0] * (-len(bits) % 8)
    return bytes(sum(b << k for k, b in enumerate(bits[i : i + 8])) for i in range(0, len(bits), 8))


def image(index, left=0, top=0, flags=0, local=b"", gce=None, size=2):
    h, w = index.shape
    clear = 1 << size
    codes = [x for v in index.ravel().tolist() for x in (clear, v)] + [clear + 1]
    head = b"" if gce is None else b"\x21\xf9\x04" + bytes([gce[0]]) + struct.pack("<H", gce[1]) + bytes([gce[2], 0])
    return head + b"\x2c" + struct.pack("<HHHHB", left, top, w, h, flags) + local + bytes([size]) + G.blocks(stream(codes, size))


@pytest.mark.parametrize("n", [1, 63, 64, 65, 5000, 16384, 16385, 70000])
def test_round_trip_of_random_and_repeated_bytes(n):
    rng = random.Random(n)
    for text in (rng.randbytes(n), b"ab" * (n // 2 + 1), b"\0" * n, bytes(rng.choice(b"etaoin ") for _ in range(n))):
        payload = G.padded(text)
        data = G.encode_samples(payload)
        frames, samples = G.decode(data)
        assert samples == payload and len(frames) == -(-len(payload) // 16384)
        assert G.lzw_codes(payload[:16384]) and G.packed(G.lzw_codes(payload[:16384])) == stream(G.lzw_codes(payload[:16384]), 8)
        assert sum(frames[0]["histogram"]) == 64 * min(256, len(payload) // 64) and frames[-1]["start_ms"] == 40 * (len(frames) - 1)


def test_deferred_clear_and_every_code_size():
    rng = random.Random(4)
    for size in range(2, 9):
        clear, codes, free = 1 << size, [1 << size], (1 << size) + 2
        text, table, before = b"", {i: bytes([i]) for i in range(clear)}, b""
        for _ in range(6000):  # runs past 4096 entries without a clear
            c = rng.choice([k for k in (rng.randrange(clear), rng.randrange(free)) if k in table])
            codes.append(c)
            text += table[c]
            if before and free < 4096:
                table[free] = before + table[c][:1]
                free += 1
            before = table[c]
        assert G.lzw_samples(stream([*codes, clear + 1], size), size) == text


def test_palettes_transparency_interlace_and_disposal():
    shared = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 255, 255, 255])
    local = bytes([0, 0, 0, 0, 0, 0, 128, 128, 128, 255, 255, 0])
    a = np.zeros((4, 4), np.uint8)
    b = np.array([[1, 2], [2, 1]], np.uint8)
    rows = np.repeat(np.array([[0], [2], [1], [3]], np.uint8), 4, axis=1)  # stored order of rows 0, 2, 1, 3
    data = b"GIF89a" + struct.pack("<HHBBB", 4, 4, 0x81, 0, 0) + shared + b"\x21\xfe\x03abc\x00"
    data += image(a, gce=(1 << 2, 5, 0)) + image(b, 1, 1, gce=(2 << 2 | 1, 7, 2)) + image(b, 0, 0, gce=(3 << 2, 0, 0)) + image(b, 2, 2, 0x81, local) + image(rows, flags=0x40) + b"\x3b"
    frames, samples = G.decode(data)
    red, green, blue, yellow, grey = 48, 12, 3, 60, 42
    got = [{k: v for k, v in enumerate(f["histogram"]) if v} for f in frames]
    assert got[0] == {red: 16} and got[1] == {red: 14, green: 2}
    assert got[2] == {red: 9, green: 2, blue: 2} and frames[2]["transparent"] == 3  # frame 1's four pixels were cleared, one of them is drawn again
    assert got[3] == {red: 9, 0: 2, grey: 2} and frames[3]["transparent"] == 3  # frame 2 was undone
    assert got[4] == {red: 4, green: 4, blue: 4, 63: 4} and yellow not in got[4]
    assert samples[-16:] == bytes([0] * 4 + [1] * 4 + [2] * 4 + [3] * 4) and [f["start_ms"] for f in frames] == [0, 50, 120, 120, 120]


def test_query_digests_and_bad_media(spark):
    texts = ["héllo", None, "", "x" * 64, "long " * 30000, "héllo"]
    df = spark.createDataFrame([(i, t, b"clash") for i, t in enumerate(texts)] + [(None, "x", b"")], "doc_id long, text string, media binary")
    got = {r.doc_id: r for r in G.report(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_sha256 == hashlib.sha256(G.encode_samples(payload)).hexdigest() and r.feature
    assert got[0].media_sha256 == got[5].media_sha256 and len(got) == 7
    good = G.encode_samples(G.padded(b"abc"))
    bad = spark.createDataFrame([(1, good), (2, good[:-20]), (3, b"nope"), (4, None), (5, good[:-1])], "doc_id long, media binary")
    back = {r.doc_id: r for r in G.decode_media(bad).collect()}
    assert back[1].error is None and all(back[i].error and back[i].frames is None for i in (2, 3, 5)) and back[4].error is None and back[4].frames is None
    assert G.timed_frames(G.decode_media(bad)).count() == 1 and G.report(df.limit(0)).count() == 0


def test_bounded_canvas_and_streams_that_expand(spark):
    huge = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0xF7, 0, 0) + G.GREY + b"\x3b"
    wide = b"GIF89a" + struct.pack("<HHBBB", 8, 8, 0xF7, 0, 0) + G.GREY + b"\x2c" + struct.pack("<HHHHB", 0, 0, 65535, 65535, 0) + b"\x08\x01\x00\x00\x3b"
    codes = [256, 0, *range(258, 4096), *[4095] * 300_000, 257]  # 1.2 GB of samples for a frame of 64
    bomb = b"GIF89a" + struct.pack("<HHBBB", 8, 8, 0xF7, 0, 0) + G.GREY + b"\x2c" + struct.pack("<HHHHB", 0, 0, 8, 8, 0) + b"\x08" + G.blocks(stream(codes, 8)) + b"\x3b"
    df = spark.createDataFrame([(1, huge, 5, "x", 6), (2, wide, 5, "x", 6), (3, bomb, 5, "x", 6)], "doc_id long, media binary, frames int, samples string, error int")
    got = {r.doc_id: r for r in G.decode_media(df).collect()}
    assert (got[1].error, got[2].error, got[3].error) == ("canvas too large", "frame too large", None)
    assert bytes(got[3].samples) == b"\0" * 64 and got[1].frames is None
    with pytest.raises(ValueError, match="canvas"):
        G.decode(G.encode_samples(b"a" * 640), most=639)
