"""Media columns: AVI files of motion JPEG, written and read without codecs.

A payload is stored as quantised coefficients, the unit of JPEG: 192 bytes are the three 8 x 8 blocks
of one MCU. Byte b becomes the coefficient b (from 128 on) or b - 255 (below), the 256 values of
magnitude category 8, whose extra bits are b itself. Both Huffman tables hold that one category with
a code of one bit, quantisers are 1, and a restart marker after each MCU resets the DC prediction, so
a baseline decoder reads every coefficient back exactly.

Reading: the RIFF tree is walked, frames are found by the idx1 index (or, where it is absent or wrong,
by walking the movi list), segment by segment, and baseline frames are decoded: this file's own kind by reshaping bits,
any other, subsampled ones and those without tables included, by a plain Huffman decoder. Shots are cut where the luminance
histogram's difference exceeds an adaptive threshold.

Defined results: null text counts as empty; an empty payload is one MCU of blanks; bytes that are no
AVI give no frames, no clips and an empty payload; a frame that can't be read (damaged, progressive,
with a table cut short) or a file cut short leaves what was read before and after, and media_error says what
was wrong first, else it is null; an empty table gives no rows.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace.llm.common import by_arrow
from terrace.llm.words import raw, slices

MCU = 192
MCUS_A_FRAME = 16
FPS = 25
BINS = 16
#: A difference of histograms is a cut beyond LEAST_CUT and beyond mean + SPREAD deviations of the WINDOW before; with less than SOME
#: differences before, beyond FIRST_CUT.
LEAST_CUT, SPREAD, WINDOW, SOME, FIRST_CUT = 0.08, 3.0, 12, 3, 0.25

#: The coefficients' zigzag order, by diagonals that turn at the edges.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
_COS = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for x in range(8)] for u in range(8)])
#: Zigzag coefficients -> 64 samples, row by row.
INVERSE = np.einsum("ux,vy->uvxy", _COS, _COS).reshape(64, 64)[ZIGZAG].astype(np.float32)


def _segment(marker: int, data: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(data) + 2) + data


def _frame_head(mcus: int) -> bytes:
    one_code = bytes([1] + [0] * 15) + b"\x08"
    return (
        b"\xff\xd8"
        + _segment(0xDB, b"\x00" + b"\x01" * 64)
        + _segment(0xC0, struct.pack(">BHHB", 8, 8, 8 * mcus, 3) + bytes([1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0]))
        + _segment(0xC4, b"\x00" + one_code)
        + _segment(0xC4, b"\x10" + one_code)
        + _segment(0xDD, struct.pack(">H", 1))
        + _segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
    )


def encode_frames(payload: np.ndarray, mcus: int) -> list[bytes]:
    """JPEG files of mcus MCUs each; payload is a multiple of MCU long and is filled up with zeros."""
    units = payload.reshape(-1, MCU)
    frames = -(-len(units) // mcus)
    if missing := frames * mcus - len(units):
        units = np.concatenate([units, np.zeros((missing, MCU), np.uint8)])
    bits = np.zeros((len(units), MCU, 9), np.uint8)
    bits[:, :, 1:] = np.unpackbits(units, axis=1).reshape(-1, MCU, 8)
    data = np.packbits(bits.reshape(len(units), -1), axis=1).tobytes()
    size, head, out = 9 * MCU // 8, _frame_head(mcus), []
    for f in range(frames):
        parts = [head]
        for k in range(mcus):
            at = (f * mcus + k) * size
            parts.append(data[at : at + size].replace(b"\xff", b"\xff\x00"))
            parts.append(bytes([0xFF, 0xD0 + k % 8]) if k < mcus - 1 else b"\xff\xd9")
        out.append(b"".join(parts))
    return out


def _chunk(kind: bytes, data: bytes) -> bytes:
    return kind + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)


def write_avi(payload: bytes) -> bytes:
    """payload (a multiple of MCU) as an AVI file with an idx1 index; its length stands in a chunk of its own."""
    total = len(payload) // MCU
    mcus = -(-total // -(-total // MCUS_A_FRAME))  # frames of equal size, few to fill up
    frames = encode_frames(np.frombuffer(payload, np.uint8), mcus)
    width, height, largest = 8 * mcus, 8, max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<I2H8I4H", 0, 0, 0, 0, 1, FPS, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<3I2H4sI4I", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    index, movi, at = [], [b"movi"], 4
    for frame in frames:
        index.append(struct.pack("<4s3I", b"00dc", 0x10, at, len(frame)))
        movi.append(_chunk(b"00dc", frame))
        at += len(movi[-1])
    body = b"AVI " + head + _chunk(b"plen", struct.pack("<Q", len(payload))) + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


@dataclass
class Avi:
    width: int = 0
    height: int = 0
    fps: float = 0.0
    payload_bytes: int | None = None
    frames: tuple[bytes, ...] = ()


def read_avi(data: bytes) -> Avi:
    """The video frames of an AVI file, by its index where that holds."""
    out, frames = Avi(), []
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        return out
    at = 0
    # A file beyond a gigabyte goes on in further RIFF segments; each has frames, and an index or none, of its own.
    while at + 8 <= len(data) and data[at : at + 4] == b"RIFF":
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        frames += _segment_frames(data, at + 12, min(len(data), at + 8 + size), out)
        at += 8 + size + size % 2
    out.frames = tuple(frames)
    return out


def _segment_frames(data: bytes, start: int, stop: int, out: Avi) -> list[bytes]:
    """Frames of one RIFF segment; what its header tells goes into out."""
    movi, index, walked = None, b"", []
    # Places within the lists that are open, the innermost last; a list's own end is not passed.
    open_lists = [(start, stop)]
    while open_lists:
        at, end = open_lists.pop()
        if at + 8 > end:
            continue
        kind, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        body, last = at + 8, min(end, at + 8 + size)
        open_lists.append((body + size + size % 2, end))
        if kind == b"LIST":
            if data[body : body + 4] == b"movi" and movi is None:
                movi = body
            open_lists.append((body + 4, last))
        elif kind == b"avih" and last - body >= 40:
            micros, out.width, out.height = *struct.unpack_from("<I", data, body), *struct.unpack_from("<2I", data, body + 32)
            out.fps = 1e6 / micros if micros else 0.0
        elif kind == b"plen" and last - body >= 8:
            out.payload_bytes = struct.unpack_from("<Q", data, body)[0]
        elif kind == b"idx1":
            index = data[body:last]
        elif kind[2:] in (b"dc", b"db"):
            walked.append(data[body:last])
    found = []
    for kind, _, offset, size in struct.iter_unpack("<4s3I", index[: len(index) // 16 * 16]):
        if kind[2:] in (b"dc", b"db"):
            at = next((b for b in (offset, (movi or 0) + offset) if data[b : b + 8] == kind + struct.pack("<I", size)), None)
            if at is None:  # a wrong index
                return walked
            found.append(data[at + 8 : at + 8 + size])
    return found if found else walked


@dataclass
class Jpeg:
    height: int
    width: int
    components: list[tuple[int, int, int]]
    quantisers: dict[int, np.ndarray]
    tables: dict[int, dict[tuple[int, int], int]]
    scan: list[tuple[int, int]]
    restart: int
    data: bytes


def huffman_table(counts: bytes | list[int], symbols: bytes | list[int]) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol; counts: codes of each length from 1 on."""
    table, code, it = {}, 0, iter(symbols)
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            table[length, code] = next(it)
            code += 1
        code <<= 1
    return table


def _run_lengths(first: str) -> list[int]:
    """Symbols of runs and sizes: those given, then all others in order."""
    given = list(bytes.fromhex(first))
    every = [0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))]
    return given + sorted(set(every) - set(given))


# The standard's typical tables, which motion JPEG frames leave out; by class and number.
STANDARD_TABLES = {
    0x00: huffman_table([0, 1, 5, 1, 1, 1, 1, 1, 1], list(range(12))),
    0x01: huffman_table([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1], list(range(12))),
    0x10: huffman_table([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125], _run_lengths("01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282")),
    0x11: huffman_table([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119], _run_lengths("0001020311040521310612415107617113223281081442 91a1b1c109233352f0156272d10a162434e125f1")),
}


def parse_jpeg(frame: bytes) -> Jpeg:
    """Markers of a baseline JPEG up to its scan."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    out, at = Jpeg(0, 0, [], {}, {}, [], 0, b""), 2
    while at + 4 <= len(frame):
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                out.quantisers[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.int32)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC0:
            _, out.height, out.width, n = struct.unpack_from(">BHHB", body)
            out.components = [(body[6 + 3 * i], body[7 + 3 * i], body[8 + 3 * i]) for i in range(n)]
        elif marker in (0xC1, 0xC2, 0xC3):
            raise ValueError("only baseline frames are read")
        elif marker == 0xC4:
            while body:
                used = sum(body[1:17])
                if len(body) < 17 + used:
                    raise ValueError("a table is cut short")
                out.tables[body[0]] = huffman_table(body[1:17], body[17 : 17 + used])
                body = body[17 + used :]
        elif marker == 0xDD:
            out.restart = struct.unpack(">H", body[:2])[0]
        elif marker == 0xDA:
            out.scan = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
            out.tables = STANDARD_TABLES | out.tables
            end = frame.rfind(b"\xff\xd9")
            out.data = frame[at + 2 + size : end if end >= 0 else len(frame)]
            return out
        at += 2 + size
    raise ValueError("no scan")


def _huffman_blocks(jpeg: Jpeg) -> list[np.ndarray]:
    """Coefficients (blocks, 64) of each component of any baseline frame, in the scan's order, bit by bit."""
    sampling = {c: (s >> 4, s & 15) for c, s, _ in jpeg.components}
    # A scan of one component has a block a unit, whatever its sampling.
    shape = [sampling[c] if len(jpeg.scan) > 1 else (1, 1) for c, _ in jpeg.scan]
    wide, high = (8 * max(x[i] for x in shape) for i in range(2))
    total = -(-jpeg.height // high) * -(-jpeg.width // wide)
    out, done = [np.zeros((total * h * v, 64), np.int32) for h, v in shape], 0
    for part in re.split(rb"\xff[\xd0-\xd7]", jpeg.data):
        bits = np.unpackbits(np.frombuffer(part.replace(b"\xff\x00", b"\xff"), np.uint8)).tolist()
        at, last = 0, [0] * len(jpeg.scan)

        def take(n: int) -> int:
            nonlocal at
            value = 0
            if at + n > len(bits) + 16:
                raise ValueError("the scan ends early")
            for b in bits[at : at + n]:
                value = value << 1 | b
            at += n
            return value

        def symbol(table: dict[tuple[int, int], int]) -> int:
            code = 0
            for length in range(1, 17):
                code = code << 1 | take(1)
                if (length, code) in table:
                    return table[length, code]
            raise ValueError("bad code")

        def value(n: int) -> int:
            v = take(n)
            return v if not n or v >> (n - 1) else v - (1 << n) + 1

        for _ in range(min(jpeg.restart or total, total - done)):
            for c, (_, tables) in enumerate(jpeg.scan):
                each = shape[c][0] * shape[c][1]
                for block in range(done * each, (done + 1) * each):
                    last[c] += value(symbol(jpeg.tables[tables >> 4]))
                    out[c][block, 0], k = last[c], 1
                    while k < 64:
                        s = symbol(jpeg.tables[0x10 | tables & 15])
                        if s == 0:
                            break
                        k += s >> 4
                        if s & 15:
                            out[c][block, k] = value(s & 15)
                        k += 1
            done += 1
    return out


def decode_units(jpeg: Jpeg) -> np.ndarray | None:
    """The bytes of a frame of this module's kind, (MCU, 192); None for other frames."""
    if jpeg.restart != 1 or len(jpeg.scan) != 3 or any(jpeg.tables.get(k) != {(1, 0): 8} for _, t in jpeg.scan for k in (t >> 4, 0x10 | t & 15)):
        return None
    parts = re.split(rb"\xff[\xd0-\xd7]", jpeg.data)
    data = np.frombuffer(b"".join([x.replace(b"\xff\x00", b"\xff") for x in parts]), np.uint8)
    bits = np.unpackbits(data.reshape(len(parts), -1), axis=1).reshape(len(parts), MCU, 9)
    return None if bits[:, :, 0].any() else np.packbits(bits[:, :, 1:], axis=2).reshape(len(parts), MCU)


def coefficients(jpeg: Jpeg) -> list[np.ndarray]:
    """(blocks, 64) of each component."""
    units = decode_units(jpeg)
    if units is None:
        return _huffman_blocks(jpeg)
    values = units.astype(np.int32)
    return list(np.where(values >= 128, values, values - 255).reshape(-1, 3, 64).transpose(1, 0, 2))


def luminance(jpeg: Jpeg, blocks: list[np.ndarray]) -> np.ndarray:
    """Samples 0 to 255 of the first component, (blocks, 64)."""
    scaled = (blocks[0] * jpeg.quantisers[jpeg.components[0][2]]).astype(np.float32)
    return np.clip(np.rint(scaled @ INVERSE + 128), 0, 255).astype(np.uint8)


def clips(histograms: np.ndarray) -> list[tuple[int, int]]:
    """(first frame, one after the last) of each shot."""
    if not len(histograms):
        return []
    steps = np.abs(np.diff(histograms, axis=0)).sum(axis=1) / 2
    cuts = []
    for t, d in enumerate(steps):
        before = steps[max(0, t - WINDOW) : t]
        if d > (max(LEAST_CUT, before.mean() + SPREAD * before.std()) if len(before) >= SOME else FIRST_CUT):
            cuts.append(t + 1)
    return list(zip([0, *cuts], [*cuts, len(histograms)], strict=True))


def read_media(media: bytes) -> tuple[bytes, str, list[dict], str | None]:
    """(payload, feature, clips, error) of an AVI file; feature: frame size, frames, clips' frames and mean histogram."""
    avi, error = Avi(), None
    try:
        avi = read_avi(media)
    except (ValueError, IndexError, struct.error) as e:
        error = f"file: {e}"
    units, histograms = [], []
    for i, frame in enumerate(avi.frames):
        try:
            jpeg = parse_jpeg(frame)
            own = decode_units(jpeg)
            light = luminance(jpeg, coefficients(jpeg))
            histograms.append(np.bincount((light >> 4).ravel(), minlength=BINS) / light.size)
        except (ValueError, IndexError, KeyError, ZeroDivisionError, struct.error) as e:
            error = error or f"frame {i}: {type(e).__name__} {e}"
            continue
        if own is not None:
            units.append(own)
    shots = clips(np.array(histograms))
    payload = np.concatenate(units).tobytes()[: avi.payload_bytes] if units else b""
    mean = np.mean(histograms, axis=0) if histograms else np.zeros(BINS)
    feature = f"{avi.width}x{avi.height};frames={len(avi.frames)};clips={','.join(f'{a}-{b}' for a, b in shots)};hist={','.join(str(round(1000 * x)) for x in mean.tolist())}"
    rows = [{"clip": i, "first_frame": a, "last_frame": b - 1, "start_s": a / avi.fps, "end_s": b / avi.fps} for i, (a, b) in enumerate(shots)] if avi.fps else []
    return payload, feature, rows, error


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: the AVI file of each text's payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in slices(batch["text"]):
                body, at = raw(texts)
                data, at = body.tobytes(), at.tolist()
                for i in range(0, len(texts), 512):
                    own = list(zip(at[i : i + 512], at[i + 1 : i + 513], strict=False))
                    media = [write_avi(data[a:b] + b" " * (max(MCU, -(-(b - a) // MCU) * MCU) - (b - a))) for a, b in own]
                    yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(lo + i, len(own)), pa.array([b - a for a, b in own], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


CLIP = "array<struct<clip:long,first_frame:long,last_frame:long,start_s:double,end_s:double>>"


def decode_media(media: DataFrame) -> DataFrame:
    """Adds payload, feature and clips to rows with a column media; the other columns stay."""
    new_columns = ("payload", "feature", "clips", "media_error")
    kept = [c for c in media.columns if c not in new_columns]
    clip_type = pa.list_(pa.struct([("clip", pa.int64()), ("first_frame", pa.int64()), ("last_frame", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64())]))

    def work(files: pa.Array) -> Iterator[tuple[int, int, dict[str, pa.Array]]]:
        for lo in range(0, len(files), 512):
            got = list(zip(*(read_media(x.as_py() or b"") for x in files.slice(lo, 512)), strict=True))
            kinds = (pa.binary(), pa.string(), clip_type, pa.string())
            yield lo, len(got[0]), {c: pa.array(x, kind) for c, x, kind in zip(new_columns, got, kinds, strict=True)}

    return by_arrow(media, kept, "media", T.StructType.fromDDL(f"payload binary, feature string, clips {CLIP}, media_error string"), work)


def clip_rows(decoded: DataFrame) -> DataFrame:
    """One row a clip: doc_id, clip, first_frame, last_frame, start_s, end_s."""
    return decoded.select("doc_id", F.explode("clips").alias("c")).select("doc_id", "c.*")


def media_digests(docs: DataFrame) -> DataFrame:
    """Encode, read back, and report on both."""
    rows = decode_media(encode_media(docs))
    return rows.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "clips",
        "media_error",
    )
