"""Media files of other makers, and words whose marks join their letters only in lower case."""

import struct

import numpy as np
import pyarrow as pa

from terrace.llm import mjpeg
from terrace.llm.queries import tokenizer_path
from terrace.llm.word_encoder import WordEncoder


def avi(seed, n=48):
    return mjpeg.write_avi(np.random.default_rng(seed).bytes(256 * n))


def test_nested_lists_end():
    deep = b""
    for _ in range(3000):
        deep = b"LIST" + struct.pack("<I", len(deep) + 4) + b"abcd" + deep
    whole = b"RIFF" + struct.pack("<I", len(deep) + 4) + b"AVI " + deep
    assert mjpeg.read_media(whole)[0] == b"" and mjpeg.read_media(whole)[2] == []


def test_every_segment_has_its_frames():
    first, second = avi(1), avi(2)
    frames = mjpeg.read_avi(first).frames + mjpeg.read_avi(second).frames
    both = first + second[:8] + b"AVIX" + second[12:]
    assert mjpeg.read_avi(both).frames == frames
    # Without an index, or with a wrong one, the second segment is walked.
    at = both.rindex(b"idx1")
    assert mjpeg.read_avi(both[:at] + b"junk" + both[at + 4 :]).frames == frames
    assert mjpeg.read_avi(both[: at + 16] + b"\xff" * 8 + both[at + 24 :]).frames == frames
    payload, feature, clips, error = mjpeg.read_media(both)
    assert error is None and f"frames={len(frames)};" in feature and clips[-1]["last_frame"] == len(frames) - 1


def bits_of(table, symbol):
    length, code = next(k for k, v in table.items() if v == symbol)
    return f"{code:0{length}b}"


def test_frames_without_tables_take_the_standards():
    tables = mjpeg.STANDARD_TABLES
    assert [len(tables[k]) for k in (0x00, 0x01, 0x10, 0x11)] == [12, 12, 162, 162]
    # Known codes of the standard: luminance AC 0/1 is 00, end of block 1010, 15/0 11111111001, 15/10 sixteen bits to the last but one.
    assert [bits_of(tables[0x10], s) for s in (0x01, 0x00, 0xF0, 0xFA)] == ["00", "1010", "11111111001", "1111111111111110"]
    assert [bits_of(tables[0x11], s) for s in (0x01, 0x00, 0xF0, 0xFA)] == ["01", "00", "1111111010", "1111111111111110"]
    rng = np.random.default_rng(4)
    blocks = np.zeros((2, 3, 64), int)
    blocks[:, :, 0] = rng.integers(-200, 200, (2, 3))
    for b in blocks.reshape(-1, 64):
        b[rng.integers(1, 64, 9)] = rng.integers(-60, 60, 9)
    blocks[0, 0, 63] = 5
    amplitude = lambda v: f"{v if v > 0 else v + (1 << int(abs(v)).bit_length()) - 1:0{int(abs(v)).bit_length()}b}" if v else ""
    bits, last = "", [0, 0, 0]
    for unit in blocks:
        for c, block in enumerate(unit):
            dc, ac = tables[min(c, 1)], tables[0x10 | min(c, 1)]
            step = int(block[0]) - last[c]
            last[c] = int(block[0])
            bits += bits_of(dc, abs(step).bit_length()) + amplitude(step)
            run = 0
            for k in range(1, 64):
                v = int(block[k])
                if not v:
                    run += 1
                    continue
                while run > 15:
                    bits, run = bits + bits_of(ac, 0xF0), run - 16
                bits += bits_of(ac, run << 4 | abs(v).bit_length()) + amplitude(v)
                run = 0
            bits += bits_of(ac, 0) if run else ""
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    head = b"\xff\xd8" + mjpeg._segment(0xDB, b"\x00" + b"\x01" * 64) + mjpeg._segment(0xC0, struct.pack(">BHHB", 8, 8, 16, 3) + bytes([1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0]))
    jpeg = mjpeg.parse_jpeg(head + mjpeg._segment(0xDA, bytes([3, 1, 0, 2, 0x11, 3, 0x11, 0, 63, 0])) + scan + b"\xff\xd9")
    got = mjpeg.coefficients(jpeg)
    assert all((got[c] == blocks[:, c]).all() for c in range(3))


def test_marks_after_capitals_and_accented_words():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    texts = ["xT̈y Été, l'été! ΑΣ ΑΣ'Α İİ Åé não.sí", "plain words", None, "", "é" * 3000 + " naïve cafés’ cafés’", "é É ẞ ſ"]
    library = Tokenizer.from_file(path)
    coder = WordEncoder(path)
    for _ in range(2):
        got = [np.frombuffer(x, coder.dtype).tolist() for x in coder.encode(pa.array(texts, pa.string()))]
        assert got == [library.encode(x or "", add_special_tokens=False).ids for x in texts]
