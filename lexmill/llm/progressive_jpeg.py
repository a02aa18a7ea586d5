"""Media columns: progressive JPEG images, decoded in numpy.

The decoder adds spectral-selection and successive-approximation scans into coefficient arrays, inverse-transforms them and
upsamples chroma to full-resolution RGB tensors. Scans whose Huffman table leaves no choice (one symbol, or ends of band
alone) have fixed places for their bits and are read as arrays; others symbol by symbol.

The encoder stores bytes without loss, one as each quantised coefficient: byte b is the coefficient b (from 128) or b - 255
(below), which all have eight bits, so the first AC scan takes a byte for each and the last bits come in a refinement scan. The
DC coefficients step between two levels, so that all their differences have nine bits.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored
from .words import buffers

_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.S)
#: Places of the 64 frequencies in a block, row by row, in zigzag order.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i % 8 if (i // 8 + i % 8) % 2 == 0 else i // 8)))
_cos = np.cos((2 * np.arange(8)[:, None] + 1) * np.arange(8) * np.pi / 16) * np.where(np.arange(8) == 0, np.sqrt(0.5), 1) / 2
#: From coefficients in zigzag order to samples: a row for each frequency, a column for each pixel of the block.
BASIS = np.einsum("yv,xu->vuyx", _cos, _cos).reshape(64, 64)[ZIGZAG].astype(np.float32)
PARTS = ((1, 4), (2, 1), (3, 1))  # components and their blocks in a unit of 16 x 16 pixels
STEP = 768


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, number: int, symbols: list[int]) -> bytes:
    """A Huffman table of one or two symbols: codes 0 and 10."""
    return _segment(0xC4, bytes([kind << 4 | number, 1, len(symbols) - 1, *[0] * 14, *symbols]))


def _bits(bits: np.ndarray) -> bytes:
    return np.packbits(np.r_[bits, np.ones(-len(bits) % 8, np.uint8)]).tobytes().replace(b"\xff", b"\xff\x00")


def _scan(component: int, low: int, high: int, before: int, shift: int, table: int, entropy: bytes) -> bytes:
    return _segment(0xDA, bytes([1, component, table, low, high, before << 4 | shift])) + entropy


def _runs(blocks: int) -> list[tuple[int, int]]:
    """Blocks as runs of ends of band: (number, exponent)."""
    whole, rest = divmod(blocks, 32767)
    return [(32767, 14)] * whole + ([(rest, rest.bit_length() - 1)] if rest else [])


def encode_payload(payload: bytes) -> bytes:
    """A progressive 4:2:0 JPEG whose coefficients are the bytes of the payload (a positive multiple of 64), then zeros."""
    units = -(-len(payload) // 384)
    wide = -(-units // 4095)
    high = -(-units // wide)
    raw = np.zeros(wide * high * 384, np.uint8)
    raw[: len(payload)] = np.frombuffer(payload, np.uint8)
    out = [b"\xff\xd8", _segment(0xFE, b"payload %d" % len(payload)), _segment(0xDB, b"\x00" + b"\x01" * 64), _segment(0xC2, struct.pack(">BHHB", 8, 16 * high, 16 * wide, 3) + b"\x01\x22\x00\x02\x11\x00\x03\x11\x00"), _table(0, 0, [9]), _table(1, 0, [7])]
    blocks, at = raw.reshape(-1, 64), 0
    scans: list[list[bytes]] = [[], [], [], [], []]
    for component, share in PARTS:
        own = blocks[at : at + share * wide * high]
        at += len(own)
        half, last = own >> 1, own & 1
        level = half[:, 0].astype(np.int32) + STEP // 2 * ((np.arange(len(own)) + 1) % 2)
        steps = np.diff(level, prepend=0)
        steps += (steps < 0) * 511
        scans[0].append(_scan(component, 0, 0, 0, 1, 0, _bits(((steps[:, None] >> np.arange(9, -1, -1)) & 1).astype(np.uint8).ravel())))
        scans[1].append(_scan(component, 1, 5, 0, 1, 0, half[:, 1:6].tobytes()))
        scans[2].append(_scan(component, 6, 63, 0, 1, 0, half[:, 6:].tobytes()))
        scans[3].append(_scan(component, 0, 0, 1, 0, 0, _bits(last[:, 0])))
        refined = last[:, 1:] ^ (own[:, 1:] < 128)
        runs = _runs(len(own))
        symbols = sorted({r << 4 for _, r in runs}, reverse=True)
        bits, begin = [], 0
        for n, r in runs:
            code = [0] if r << 4 == symbols[0] else [1, 0]
            bits += [np.array([*code, *((n - (1 << r)) >> k & 1 for k in range(r - 1, -1, -1))], np.uint8), refined[begin : begin + n].ravel()]
            begin += n
        scans[4].append(_table(1, 1, symbols) + _scan(component, 1, 63, 1, 0, 1, _bits(np.concatenate(bits))))
    return b"".join([*out, *(x for scan in scans for x in scan), b"\xff\xd9"])


@dataclass
class _Component:
    number: int
    h: int
    v: int
    quantiser: int
    wide: int = 0  # blocks in a scan of this component alone
    high: int = 0
    row: int = 0  # blocks in a row of the array
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int32))

    def own(self) -> np.ndarray:
        """The blocks of a scan of this component alone, by their place in the array."""
        return (np.arange(self.high)[:, None] * self.row + np.arange(self.wide)).ravel()


class _Reader:
    """Bits of an entropy-coded part, one after the other."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = np.unpackbits(np.frombuffer(data, np.uint8)).tolist(), 0

    def bit(self) -> int:
        self.at += 1
        return self.data[self.at - 1] if self.at <= len(self.data) else 0

    def number(self, n: int) -> int:
        x = 0
        for _ in range(n):
            x = x << 1 | self.bit()
        return x

    def signed(self, n: int) -> int:
        x = self.number(n)
        return x if not n or x >> (n - 1) else x - (1 << n) + 1

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.bit()
            if (n, code) in codes:
                return codes[n, code]
        raise ValueError("no such Huffman code")


def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    out, code, at = {}, 0, 0
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            out[n, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _fixed(data: bytes, n: int, size: int) -> np.ndarray:
    """n numbers of 1 + size bits whose first bit is the code 0, as signed values of `size` bits."""
    if size == 7:
        x = np.frombuffer(data, np.uint8, n).astype(np.int32)
    else:
        bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * (1 + size)).reshape(n, 1 + size)
        x = bits @ (1 << np.arange(size, -1, -1))
    return np.where(x >> (size - 1), x, x - (1 << size) + 1)


def _refine_run(band: np.ndarray, bits: np.ndarray, shift: int) -> int:
    """Correction bits of all coefficients of the band that aren't zero; returns how many there were."""
    if band.all():
        n = band.size
        band += np.sign(band) * (bits[:n].reshape(band.shape).astype(np.int32) << shift)
        return n
    known = np.nonzero(band)
    n = len(known[0])
    band[known] += np.sign(band[known]) * (bits[:n].astype(np.int32) << shift)
    return n


def _one_component(part: _Component, data: bytes, dc: dict, ac: dict, low: int, high: int, before: int, shift: int) -> bool:
    """Reads a scan whose bits have fixed places; False if it hasn't."""
    own = part.own()
    if not low and before:
        part.coefficients[own, 0] |= np.unpackbits(np.frombuffer(data, np.uint8), count=len(own)).astype(np.int32) << shift
        return True
    if not before:
        codes = ac if low else dc
        if set(codes) != {(1, 0)} or codes[1, 0] >> 4 or not codes[1, 0]:
            return False
        width = high - low + 1
        values = _fixed(data, len(own) * width, codes[1, 0]).reshape(len(own), width)
        part.coefficients[own, low : high + 1] = (np.cumsum(values, 0) if not low else values) * (1 << shift)
        return True
    if any(x & 15 or x >> 4 == 15 for x in ac.values()):
        return False
    bits, at, done = np.unpackbits(np.frombuffer(data, np.uint8)), 0, 0
    contiguous = part.row == part.wide
    while done < len(own):
        code = length = 0
        while (length, code) not in ac:
            code, length, at = code << 1 | int(bits[at]), length + 1, at + 1
        r = ac[length, code] >> 4
        n = (1 << r) + int("0" + "".join(map(str, bits[at : at + r].tolist())), 2)
        at += r
        rows = slice(done, done + n) if contiguous else own[done : done + n]
        band = part.coefficients[rows, low : high + 1]
        at += _refine_run(band, bits[at:], shift)
        if not contiguous:
            part.coefficients[rows, low : high + 1] = band
        done += n
    return True


def _refine_block(reader: _Reader, block: np.ndarray, ac: dict, low: int, high: int, shift: int, run: int) -> int:
    """One block of an AC refinement scan; returns the blocks left in the run of ends of band."""
    k, unit = low, 1 << shift
    correct = lambda k: reader.bit() and block.__setitem__(k, block[k] + (unit if block[k] > 0 else -unit))
    if not run:
        while k <= high:
            symbol = reader.symbol(ac)
            zeros, size = symbol >> 4, symbol & 15
            value = 0
            if size:
                value = unit if reader.bit() else -unit
            elif zeros < 15:
                run = (1 << zeros) + reader.number(zeros)
                break
            while k <= high:
                if block[k]:
                    correct(k)
                elif zeros:
                    zeros -= 1
                else:
                    break
                k += 1
            if k <= high and value:
                block[k] = value
            k += 1
    if run:
        for j in range(k, high + 1):
            if block[j]:
                correct(j)
        run -= 1
    return run


def _by_symbol(parts: list[_Component], size: tuple[int, int], pieces: list[bytes], interval: int, dc: list[dict], ac: list[dict], low: int, high: int, before: int, shift: int) -> None:
    """Any scan, symbol by symbol."""
    if len(parts) == 1:
        order = [[(0, int(b))] for b in parts[0].own()]
    else:
        order = [[(i, (y * p.v + v) * p.row + x * p.h + h) for i, p in enumerate(parts) for v in range(p.v) for h in range(p.h)] for y in range(size[1]) for x in range(size[0])]
    step = interval or len(order)
    for piece, begin in zip(pieces, range(0, len(order), step), strict=False):
        reader, level, run = _Reader(piece), [0] * len(parts), 0
        for unit in order[begin : begin + step]:
            for i, b in unit:
                block = parts[i].coefficients[b]
                if not low:
                    if before:
                        block[0] |= reader.bit() << shift
                    else:
                        level[i] += reader.signed(reader.symbol(dc[i]))
                        block[0] = level[i] * (1 << shift)
                elif before:
                    run = _refine_block(reader, block, ac[i], low, high, shift, run)
                elif run:
                    run -= 1
                else:
                    k = low
                    while k <= high:
                        symbol = reader.symbol(ac[i])
                        zeros, bits = symbol >> 4, symbol & 15
                        if bits:
                            k += zeros
                            block[k] = reader.signed(bits) * (1 << shift)
                            k += 1
                        elif zeros == 15:
                            k += 16
                        else:
                            run = (1 << zeros) + reader.number(zeros) - 1
                            break


@dataclass
class Image:
    """Coefficients of the components (zigzag order), their quantisers, and what comments say."""

    width: int
    height: int
    components: list[_Component]
    quantisers: dict[int, np.ndarray]
    comments: list[bytes]


def decode_coefficients(data: bytes, by_symbol: bool = False) -> Image:
    """Adds up all scans of a progressive JPEG of 8-bit samples. by_symbol: never read a scan as an array."""
    image, huffman, interval, units = Image(0, 0, [], {}, []), {}, 0, (0, 0)
    at = 2
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    while True:
        marker = data[at + 1]
        if marker == 0xD9:
            return image
        length = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body, at = data[at + 4 : at + 2 + length], at + 2 + length
        if marker == 0xFE:
            image.comments.append(body)
        elif marker == 0xDB:
            while body:
                n = 128 if body[0] >> 4 else 64
                image.quantisers[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if n == 128 else np.uint8).astype(np.float32)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huffman[body[0] >> 4, body[0] & 15] = _codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xC2:
            _, image.height, image.width, n = struct.unpack(">BHHB", body[:6])
            image.components = [_Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            most_h, most_v = max(c.h for c in image.components), max(c.v for c in image.components)
            units = (-(-image.width // (8 * most_h)), -(-image.height // (8 * most_v)))
            for c in image.components:
                c.wide, c.high = -(-(-(-image.width * c.h // most_h)) // 8), -(-(-(-image.height * c.v // most_v)) // 8)
                c.row = units[0] * c.h
                c.coefficients = np.zeros((c.row * units[1] * c.v, 64), np.int32)
        elif marker == 0xDA:
            n = body[0]
            parts = [next(c for c in image.components if c.number == body[1 + 2 * i]) for i in range(n)]
            tables = [body[2 + 2 * i] for i in range(n)]
            low, high, rest = body[1 + 2 * n : 4 + 2 * n]
            end = _MARKER.search(data, at).start()
            dc, ac = [huffman.get((0, t >> 4), {}) for t in tables], [huffman.get((1, t & 15), {}) for t in tables]
            entropy, at = data[at:end], end
            if by_symbol or n > 1 or interval or not _one_component(parts[0], entropy.replace(b"\xff\x00", b"\xff"), dc[0], ac[0], low, high, rest >> 4, rest & 15):
                pieces = [x.replace(b"\xff\x00", b"\xff") for x in (re.split(rb"\xff[\xd0-\xd7]", entropy) if interval else [entropy])]
                _by_symbol(parts, units, pieces, interval, dc, ac, low, high, rest >> 4, rest & 15)
        elif marker in (0xC0, 0xC1, 0xC3):
            raise ValueError("not a progressive JPEG")


def rgb(image: Image) -> np.ndarray:
    """The picture as (height, width, 3) bytes; one component gives grey."""
    most_h, most_v = max(c.h for c in image.components), max(c.v for c in image.components)
    planes = []
    for c in image.components:
        samples = (c.coefficients.astype(np.float32) * image.quantisers[c.quantiser]) @ BASIS
        plane = (samples + 128).clip(0, 255).reshape(-1, c.row, 8, 8).transpose(0, 2, 1, 3).reshape(-1, 8 * c.row)
        if (c.v, c.h) != (most_v, most_h):
            plane = plane.repeat(most_v // c.v, 0).repeat(most_h // c.h, 1)
        planes.append(plane[: image.height, : image.width])
    if len(planes) < 3:
        planes = [planes[0], np.full_like(planes[0], 128), np.full_like(planes[0], 128)]
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    out = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1)
    return np.rint(out).clip(0, 255).astype(np.uint8)


def payload_of(image: Image) -> bytes:
    """The bytes that encode_payload stored."""
    size = next(int(c.split()[1]) for c in image.comments if c.startswith(b"payload "))
    parts = []
    for c in image.components:
        own = c.coefficients
        values = np.where(own < 0, own + 255, own)
        values[:, 0] = own[:, 0] - STEP * ((np.arange(len(own)) + 1) % 2)
        parts.append(values.astype(np.uint8).ravel())
    return np.concatenate(parts)[:size].tobytes()


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        data, n = data.tobytes(), np.diff(offsets)
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + (4 << 20), "right")) - 1)
            end = min(end, batch.num_rows)
            media = []
            for i in range(begin, end):
                text = data[offsets[i] : offsets[i + 1]]
                media.append(encode_payload(text + bytes(-len(text) % 64 if text else 64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[begin:end], pa.array(n[begin:end]), pa.array(media, pa.binary())], schema=schema)
            begin = end


def text_images(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes (of the text's UTF-8), media (its bytes and zeros up to a multiple of 64 as a progressive JPEG).

    Null texts count as empty, and an empty text gives 64 zeros. Repeated rows give equal images; an empty table gives an empty
    one; other columns are not read.
    """
    docs = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return docs.mapInArrow(_encoded, "doc_id long, n_bytes long, media binary")


def _tensors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            picture = rgb(decode_coefficients(media)) if media else None
            yield pa.RecordBatch.from_pydict({"media_id": pa.array([key], pa.int64()), "height": pa.array([picture.shape[0] if media else None], pa.int32()), "width": pa.array([picture.shape[1] if media else None], pa.int32()), "rgb": pa.array([picture.tobytes() if media else None], pa.binary())})


def decode_media(images: DataFrame, id_column: str = "doc_id", media_column: str = "media") -> DataFrame:
    """Per row: media_id, height, width, rgb (height x width x 3 bytes, full resolution). Null or empty media give nulls."""
    return images.select(F.col(id_column).cast("long").alias("media_id"), F.col(media_column).alias("media")).mapInArrow(_tensors, "media_id long, height int, width int, rgb binary")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in DIGEST.split(", ")]
    for batch in batches:
        out = []
        for media in batch.column("media").to_pylist():
            image = decode_coefficients(media)
            payload, picture = payload_of(image), rgb(image)
            means = [f"{x / picture[..., 0].size:.3f}" for x in picture.reshape(-1, 3).sum(0, dtype=np.int64).tolist()]
            out.append((len(payload), sha256(payload).hexdigest(), crc32(payload[-64:]), len(media), sha256(media).hexdigest(), f"{image.width}x{image.height} rgb {' '.join(means)}"))
        columns = zip(*out, strict=True) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], names=names)


def media_digests(documents: DataFrame) -> DataFrame:
    """Stores the images of all texts, reads them back and decodes them: sizes, digests and mean colour."""
    return stored(text_images(documents), "media", "zstd").mapInArrow(_digests, DIGEST)
