"""Motion-JPEG AVI columns: write, parse by RIFF index, decode intra frames, cut into timed clips.

Bytes are stored losslessly as samples of grey frames. A frame is a baseline JPEG whose 8x8 blocks are
flat: with a DC quantiser of 8 a flat block of value v has the DC coefficient v - 128 exactly, so any
decoder gives the byte back. The Huffman table is laid out so that code, extra bits and end-of-block
together take 16 bits for every difference, which lets numpy code and decode whole frames by a lookup.
Frames with any other tables go through the general baseline decoder.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes a payload is padded to a multiple of, and samples of a frame's row.
ROW = 64
#: Rows of a frame at most.
MAX_ROWS = 64
FPS = 25
#: Shots: grey levels of a histogram; a cut needs a difference of CUT_LEAST and of mean + CUT_SIGMAS deviations of the last CUT_WINDOW.
BINS, CUT_LEAST, CUT_SIGMAS, CUT_WINDOW = 16, 0.25, 3.0, 8
#: Rows handed on at once.
BATCH = 256

# ---------------------------------------------------------------- JPEG, coding

#: Category c has a code of 15 - c bits: with c extra bits and a one-bit end of block that makes 16.
DC_LENGTHS = {15 - c: [c] for c in range(9)}


def canonical(lengths: dict[int, list[int]]) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol, by the JPEG rule: codes count up, and shift left for each longer length."""
    out, code, last = {}, 0, 0
    for n in sorted(lengths):
        code <<= n - last
        last = n
        for s in lengths[n]:
            out[n, code] = s
            code += 1
    return out


@lru_cache(None)
def word_tables() -> tuple[np.ndarray, np.ndarray]:
    """difference + 255 -> 16-bit word, and word -> difference (999: none)."""
    codes = {s: (n, c) for (n, c), s in canonical(DC_LENGTHS).items()}
    words, back = np.zeros(511, ">u2"), np.full(65536, 999, np.int16)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        extra = d if d >= 0 else d + (1 << c) - 1
        word = (codes[c][1] << (c + 1)) | (extra << 1)
        words[d + 255], back[word] = word, d
    return words, back


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def huffman_body(kind: int, lengths: dict[int, list[int]]) -> bytes:
    return bytes([kind, *(len(lengths.get(n, [])) for n in range(1, 17))]) + bytes(s for n in sorted(lengths) for s in lengths[n])


@lru_cache(256)
def jpeg_head(rows: int) -> bytes:
    """All of a frame up to its entropy-coded data."""
    return (
        b"\xff\xd8"
        + segment(0xDB, bytes([0]) + bytes([8] * 64))
        + segment(0xC0, struct.pack(">BHHB", 8, rows * 8, ROW * 8, 1) + bytes([1, 0x11, 0]))
        + segment(0xC4, huffman_body(0x00, DC_LENGTHS))
        + segment(0xC4, huffman_body(0x10, {1: [0]}))
        + segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """samples: uint8 [frames, rows, ROW]."""
    n, rows, _ = samples.shape
    dc = samples.reshape(n, -1).astype(np.int16) - 128
    diff = np.diff(dc, axis=1, prepend=np.int16(0))
    data = word_tables()[0][diff + 255]
    head = jpeg_head(rows)
    return [head + x.tobytes() + b"\xff\xd9" for x in data]


# ---------------------------------------------------------------- JPEG, decoding

#: The zig-zag order of a block's coefficients.
ZIGZAG = np.array([y * 8 + x for s in range(15) for y, x in ([(s - i, i) for i in range(s + 1)] if s % 2 == 0 else [(i, s - i) for i in range(s + 1)]) if y < 8 and x < 8])


def idct(blocks: np.ndarray) -> np.ndarray:
    """[n, 8, 8] coefficients -> grey values 0..255."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    c = np.cos((2 * x + 1) * k * np.pi / 16) / 2
    c[0] /= np.sqrt(2)
    return np.clip(np.rint(c.T @ blocks @ c) + 128, 0, 255).astype(np.uint8)


class JpegError(ValueError):
    """A frame that isn't a baseline JPEG, or is cut off."""


def decode_frame(jpeg: bytes) -> np.ndarray:
    """Brightness of each 8x8 block's samples: [height/8, width/8] for flat blocks, else [height, width]."""
    if jpeg[:2] != b"\xff\xd8":
        raise JpegError("no start of image")
    at, tables, quant, parts, restart = 2, {}, {}, [], 0
    height = width = 0
    while True:
        if at + 4 > len(jpeg) or jpeg[at] != 0xFF:
            raise JpegError("cut off")
        marker, n = jpeg[at + 1], int.from_bytes(jpeg[at + 2 : at + 4], "big")
        body = jpeg[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                raw = np.frombuffer(body[1 : 1 + 64 * (1 + wide)], ">u2" if wide else np.uint8)
                quant[body[0] & 15] = raw.astype(np.int64)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                counts = body[1:17]
                symbols, lengths, k = body[17 : 17 + sum(counts)], {}, 0
                for i, m in enumerate(counts, 1):
                    if m:
                        lengths[i] = list(symbols[k : k + m])
                        k += m
                tables[body[0]] = lengths
                body = body[17 + sum(counts) :]
        elif marker in (0xC0, 0xC1):
            height, width = struct.unpack(">HH", body[1:5])
            parts = [[body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i], 0, 0] for i in range(body[5])]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise JpegError("not baseline")
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            for i in range(body[0]):
                for p in parts:
                    if p[0] == body[1 + 2 * i]:
                        p[4:] = [body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15]
            break
    end = jpeg.rfind(b"\xff\xd9")
    data = jpeg[at : end if end >= at else len(jpeg)]
    if not parts:
        raise JpegError("no frame header")
    if len(parts) == 1 and not restart and tables.get(parts[0][4]) == DC_LENGTHS and tables.get(16 + parts[0][5]) == {1: [0]} and quant[parts[0][3]][0] == 8:
        n = (height // 8) * (width // 8)
        diff = word_tables()[1][np.frombuffer(data, ">u2", n)]
        if (diff == 999).any():
            raise JpegError("bad code")
        return (np.cumsum(diff, dtype=np.int32) + 128).astype(np.uint8).reshape(height // 8, width // 8)
    return decode_scan(data, parts, tables, quant, height, width, restart)


def decode_scan(data: bytes, parts: list, tables: dict, quant: dict, height: int, width: int, restart: int) -> np.ndarray:
    """The first component of any baseline scan, block by block."""
    codes = {k: canonical(v) for k, v in tables.items()}
    most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
    if len(parts) == 1:
        parts[0][1] = parts[0][2] = most_h = most_v = 1
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    grid = np.zeros((down * parts[0][2], across * parts[0][1], 64))
    pieces, start, i = [], 0, 0
    while i < len(data) - 1:  # restart markers part the scan
        if data[i] == 0xFF and 0xD0 <= data[i + 1] <= 0xD7:
            pieces.append(data[start:i])
            start = i = i + 2
        else:
            i += 1
    pieces.append(data[start:])
    streams = iter(pieces)
    bits, at = "", 0

    def symbol(table: dict) -> int:
        nonlocal at
        code = 0
        for n in range(1, 17):
            if at >= len(bits):
                raise JpegError("cut off")
            code = code * 2 + (bits[at] == "1")
            at += 1
            if (n, code) in table:
                return table[n, code]
        raise JpegError("bad code")

    def extra(n: int) -> int:
        nonlocal at
        if not n:
            return 0
        v = int(bits[at : at + n] or "0", 2)
        at += n
        return v if v >> (n - 1) else v - (1 << n) + 1

    for mcu in range(across * down):
        if mcu == 0 or (restart and mcu % restart == 0):
            bits, at = "".join(f"{b:08b}" for b in next(streams, b"").replace(b"\xff\x00", b"\xff")), 0
            last = [0] * len(parts)
        for k, (_, h, v, q, dc, ac) in enumerate(parts):
            for y in range(v):
                for x in range(h):
                    block = np.zeros(64)
                    last[k] += extra(symbol(codes[dc]))
                    block[0] = last[k]
                    i = 1
                    while i < 64:
                        s = symbol(codes[16 + ac])
                        if s == 0:
                            break
                        i += s >> 4
                        if s & 15:
                            block[min(i, 63)] = extra(s & 15)
                        i += 1
                    if k == 0:
                        out = np.zeros(64)
                        out[ZIGZAG] = block * quant[q]
                        grid[mcu // across * v + y, mcu % across * h + x] = out
    rows, cols, _ = grid.shape
    image = idct(grid.reshape(-1, 8, 8)).reshape(rows, cols, 8, 8).swapaxes(1, 2).reshape(rows * 8, cols * 8)
    return image[:height, :width]


# ---------------------------------------------------------------- AVI


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(payload: bytes) -> bytes:
    """payload: a positive multiple of ROW bytes."""
    rows = len(payload) // ROW
    n = -(-rows // MAX_ROWS)
    high = -(-rows // n)
    samples = np.zeros(n * high * ROW, np.uint8)
    samples[: len(payload)] = np.frombuffer(payload, np.uint8)
    frames = encode_frames(samples.reshape(n, high, ROW))
    w, h, most = ROW * 8, high * 8, max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, n, 0, 1, most, w, h, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, n, most, 10_000, 0, 0, 0, w, h)
    strf = struct.pack("<IiiHH4sIiiII", 40, w, h, 1, 24, b"MJPG", w * h * 3, 0, 0, 0, 0)
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        c = chunk(b"00dc", f)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movi.append(c)
        at += len(c)
    return chunk(b"RIFF", b"AVI " + head + chunk(b"lxpl", struct.pack("<Q", len(payload))) + chunk(b"LIST", b"".join(movi)) + chunk(b"idx1", b"".join(index)))


class AviError(ValueError):
    """Bytes that aren't a RIFF AVI file."""


def riff_chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start of body, size); a size that points past the end is cut to it."""
    while at + 8 <= end:
        name, n = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        n = min(n, end - at - 8)
        yield name, at + 8, n
        at += 8 + n + n % 2


def read_avi(data: bytes) -> tuple[list[bytes], float, int | None]:
    """Frames by the RIFF index (or by walking movi where there is none), milliseconds a frame, payload bytes."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise AviError("not an AVI file")
    step, movi, index, length = 1000 / FPS, None, None, None
    for name, at, n in riff_chunks(data, 12, len(data)):
        if name == b"LIST" and data[at : at + 4] == b"hdrl":
            for inner, a, _ in riff_chunks(data, at + 4, at + n):
                if inner == b"avih":
                    step = int.from_bytes(data[a : a + 4], "little") / 1000
        elif name == b"LIST" and data[at : at + 4] == b"movi":
            movi = (at, n)
        elif name == b"idx1":
            index = np.frombuffer(data[at : at + n // 16 * 16], np.dtype([("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("n", "<u4")]))
        elif name == b"lxpl":
            length = int.from_bytes(data[at : at + 8], "little")
    if movi is None:
        raise AviError("no movi list")
    if index is not None and len(index):
        own = index[index["id"] == b"00dc"]
        base = movi[0] if data[movi[0] + int(own["at"][0]) :][:4] == b"00dc" else 0  # offsets may count from the file's start
        frames = [data[base + int(a) + 8 : base + int(a) + 8 + int(n)] for a, n in zip(own["at"], own["n"], strict=True)]
    else:
        frames = [data[a : a + n] for name, a, n in riff_chunks(data, movi[0] + 4, sum(movi)) if name == b"00dc"]
    return frames, step, length


def shots(images: list[np.ndarray]) -> tuple[list[int], list[float]]:
    """First frames of the shots, and each frame's histogram difference to the one before (0 for the first).

    A cut is a difference of at least CUT_LEAST that is over mean + CUT_SIGMAS deviations of up to
    CUT_WINDOW earlier differences of its own shot.
    """
    hists = [np.bincount(x.ravel() >> 4, minlength=BINS) / max(1, x.size) for x in images]
    starts, diffs, recent = [0] if images else [], [0.0] if images else [], []
    for i in range(1, len(hists)):
        d = float(np.abs(hists[i] - hists[i - 1]).sum() / 2)
        limit = np.mean(recent) + CUT_SIGMAS * np.std(recent) if recent else 0.0
        if d >= CUT_LEAST and d > limit:
            starts.append(i)
            recent = []
        else:
            recent = [*recent[1 - CUT_WINDOW :], d]
        diffs.append(d)
    return starts, diffs


def clip_rows(data: bytes) -> list[tuple[int, int, int, float, float, float]]:
    """(clip, first frame, frames, start ms, end ms, mean brightness) of a file."""
    frames, step, _ = read_avi(data)
    images = [decode_frame(f) for f in frames]
    starts, _ = shots(images)
    ends = [*starts[1:], len(images)]
    return [(i, a, b - a, a * step, b * step, float(np.mean([x.mean() for x in images[a:b]]))) for i, (a, b) in enumerate(zip(starts, ends, strict=True))]


# ---------------------------------------------------------------- Spark


def clips(media: DataFrame, key: str = "doc_id", content: str = "media") -> DataFrame:
    """Timed clip rows of a column of AVI files: key, clip, first_frame, frames, start_ms, end_ms, brightness, error.

    A null file has no rows. A file that can't be parsed gives one row with only the key and the error.
    """
    schema = f"{key} {dict(media.dtypes)[key]}, clip long, first_frame long, frames long, start_ms double, end_ms double, brightness double, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if data.is_valid:
                    try:
                        rows += [(k, *r, None) for r in clip_rows(data.as_py())]
                    except (ValueError, KeyError, IndexError, struct.error) as e:
                        rows.append((k, None, None, None, None, None, None, str(e)))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [batch.schema.field(0).type, *[pa.int64()] * 3, *[pa.float64()] * 3, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["k", "clip", "first_frame", "frames", "start_ms", "end_ms", "brightness", "error"])

    return media.select(key, content).mapInArrow(run, schema)


def padded(data: bytes) -> bytes:
    return data + b"\0" * (max(ROW, -(-len(data) // ROW) * ROW) - len(data))


def store_text(text: str | None) -> bytes:
    """A text as an AVI file."""
    return write_avi(padded((text or "").encode()))


def digest(n_bytes: int, media: bytes) -> tuple:
    """What op9 returns of a file, all read back from its frames."""
    frames, step, length = read_avi(media)
    images = [decode_frame(f) for f in frames]
    payload = np.concatenate([x.ravel() for x in images]).tobytes()[:length]
    starts, diffs = shots(images)
    mean = sum(payload) / len(payload)
    feature = f"frames={len(images)};shots={len(starts)};cuts={','.join(f'{s * step:.0f}' for s in starts[1:])};peak={max(diffs):.6f};mean={mean:.6f}"
    return n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature


def text_media(docs: DataFrame) -> DataFrame:
    """Store every text as an AVI file, read the file back, and return its digests and features.

    Files are made and read in the task, so nothing larger than a row crosses to the JVM.
    Nulls: a null text is an empty one (64 zero bytes); a null doc_id stays null. Equal texts have
    equal values, repeated rows stay, an empty table gives an empty result, other columns are not read.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                rows = []
                for k, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    rows.append((k, *digest(len((text or "").encode()), store_text(text))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))
