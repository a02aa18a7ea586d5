"""Fill-in-the-middle: whole texts cut into prefix, middle and suffix at unit boundaries, and put together in another order.

A unit is a run of ASCII letters or any other single character. Units are counted over blocks of UTF-8 bytes; every CHECKPOINT
units of a text the byte and code-point offsets are recorded and all other positions forgotten. A cut is then found by a binary
search of the checkpoints and a rescan of the bytes up to the next one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .tokens import gathered
from .words import buffers, give_back

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
CHECKPOINT = 256
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = True
RESULT = [StructField("n", LongType()), StructField("form", StringType()), StructField("prefix_chars", LongType()), StructField("middle_chars", LongType()), StructField("output", StringType())]


def _unit_starts(data: np.ndarray, begins: np.ndarray, after_letter: bool) -> np.ndarray:
    """Which bytes begin a unit. begins: bytes at which a text (or a stretch that starts with a unit) begins."""
    letter = LETTERS[data]
    inner = np.zeros(len(data), bool)
    inner[1:] = letter[1:] & letter[:-1]
    if len(data):
        inner[0] = after_letter and letter[0]
    inner[begins] = False
    return ~inner & (data & 0xC0 != 0x80)


class UnitIndex:
    """Of texts end to end: n (units of each), and the checkpoints by number of units before them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, every: int = CHECKPOINT, block: int = 1 << 20) -> None:
        self.data, self.offsets, self.every = data, offsets, every
        self.n = np.zeros(len(offsets) - 1, np.int64)
        units, places, points, points_before = [], [], [], 0
        units_before = 0
        for b in range(0, len(data), block):
            part = data[b : b + block]
            inside = offsets[np.searchsorted(offsets, b) : np.searchsorted(offsets, b + len(part))] - b
            at = np.flatnonzero(_unit_starts(part, inside, b > 0 and bool(LETTERS[data[b - 1]])))
            row = np.searchsorted(offsets, at + b, "right") - 1
            # the place of each unit in its text: units of the text in earlier blocks, then those in this one
            fresh = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
            size = np.diff(np.r_[fresh, len(row)])
            place = np.arange(len(row)) - np.repeat(fresh - self.n[row[fresh]], size)
            self.n[row[fresh]] += size
            heads = np.cumsum(part & 0xC0 != 0x80)
            take = np.flatnonzero(place % every == 0)
            units.append(units_before + take)
            places.append(at[take] + b)
            points.append(points_before + heads[at[take]] - 1)
            points_before += int(heads[-1])
            units_before += len(at)
        none = [np.zeros(0, np.int64)]
        self.units, self.places, self.points = (np.concatenate(x or none) for x in (units, places, points))
        self.first = np.cumsum(self.n) - self.n

    def find(self, row: np.ndarray, cut: np.ndarray, most: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and code points of the text `row` before its unit number `cut`, which is below the text's number of units."""
        own = self.first[row] + cut
        check = np.searchsorted(self.units, own, "right") - 1
        begin = self.places[check]
        following = np.r_[self.places, len(self.data)][check + 1]
        end = np.minimum(following, self.offsets[row + 1])
        head = self.points[np.searchsorted(self.units, self.first[row])]
        found, points = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        size, i = np.cumsum(end - begin), 0
        while i < len(row):
            j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + most, "right")))
            length = end[i:j] - begin[i:j]
            base = np.cumsum(length) - length
            part = self.data[np.repeat(begin[i:j] - base, length) + np.arange(int(length.sum()))]
            at = np.flatnonzero(_unit_starts(part, base, False))
            hit = at[np.searchsorted(at, base) + own[i:j] - self.units[check[i:j]]]
            heads = np.cumsum(part & 0xC0 != 0x80)
            found[i:j] = begin[i:j] + hit - base - self.offsets[row[i:j]]
            points[i:j] = self.points[check[i:j]] + heads[hit] - heads[base] - head[i:j]
            i = j
        return found, points


def _cut(text: pa.Array, hashes: list[np.ndarray], fim_percent: int, spm_percent: int, every: int) -> list[pa.Array]:
    data, offsets = buffers(text)
    index = UnitIndex(data, offsets, every)
    rows = len(text)
    cuts = np.sort(np.stack([h % (index.n + 1) for h in hashes[:2]]), 0)
    length = np.diff(offsets)
    chars = pc.fill_null(pc.utf8_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    marked = np.zeros(rows, bool)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked |= pc.fill_null(pc.match_substring(text, mark.decode()), False).to_numpy(zero_copy_only=False)
    plain = (length == 0) | marked | (hashes[2] % 100 >= fim_percent)
    spm = hashes[3] % 100 < spm_percent
    ends, points = np.tile(length, (2, 1)), np.tile(chars, (2, 1))
    for k in (0, 1):
        inner = np.flatnonzero(~plain & (cuts[k] < index.n))
        ends[k, inner], points[k, inner] = index.find(inner, cuts[k, inner])
    raw, output = data.tobytes(), []
    for own_plain, own_spm, begin, a, b, end in zip(plain.tolist(), spm.tolist(), offsets[:-1].tolist(), (offsets[:-1] + ends[0]).tolist(), (offsets[:-1] + ends[1]).tolist(), offsets[1:].tolist(), strict=True):
        if own_plain:
            output.append(raw[begin:end])
        elif own_spm:
            output.append(b"".join((SUFFIX, raw[b:end], PREFIX, raw[begin:a], MIDDLE, raw[a:b])))
        else:
            output.append(b"".join((PREFIX, raw[begin:a], SUFFIX, raw[b:end], MIDDLE, raw[a:b])))
    form = np.where(plain, PLAIN, np.where(spm, SPM, PSM))
    return [pa.array(index.n), pa.array(form, pa.string()), pa.array(points[0], mask=plain), pa.array(points[1] - points[0], mask=plain), pa.array(output, pa.binary()).cast(pa.string())]


def _transformed(fim_percent: int, spm_percent: int, every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, text="_fim_text"):
            table = table.combine_chunks()
            hashes = [table[f"_fim_{k}"].to_numpy() for k in range(4)]
            made = _cut(table["_fim_text"].chunk(0), hashes, fim_percent, spm_percent, every)
            kept = [c for c in table.column_names if not c.startswith("_fim_")]
            yield pa.RecordBatch.from_arrays([*(table[c].chunk(0) for c in kept), *made], names=[*kept, *(f.name for f in RESULT)])
        give_back()

    return run


def draws(id_column: Column, seed: int = 1, count: int = 4) -> list[Column]:
    """Numbers of 32 bits from the id alone: eight hex digits each of the sha-256 of "seed:id" (of "seed:" if the id is null)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(count)]


def fill_in_middle(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",), seed: int = 1, fim_percent: int = 90, spm_percent: int = 20, every: int = CHECKPOINT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: the columns in `keep`, n (units), form, prefix_chars, middle_chars (null for plain rows), output.

    Null texts count as empty. Empty texts, texts that hold a mark and the 100 - fim_percent of the ids stay plain; spm_percent
    of the others put the suffix first. Cuts depend on the id and the text alone, so repeated rows get equal values and reruns
    agree; rows with a null id draw as one id does. An empty table gives an empty one. Texts of any length stand alone in a
    batch and are scanned by blocks; nothing is shuffled. Columns of `keep` must not be named as those of the result.
    """
    clash = sorted({*keep} & {f.name for f in RESULT}) or sorted(c for c in keep if c.startswith("_fim_"))
    if clash:
        raise ValueError(f"columns named as the result's: {', '.join(clash)}")
    drawn = [x.alias(f"_fim_{k}") for k, x in enumerate(draws(F.col(id_column), seed))]
    docs = documents.select(*keep, *drawn, F.col(text_column).cast("string").alias("_fim_text"))
    schema = StructType([*docs.schema.fields[: len(keep)], *RESULT])
    return docs.mapInArrow(_transformed(fim_percent, spm_percent, every), schema)


def restored(output: Column, form: Column) -> Column:
    """The text, from output and form alone: the three parts stand between marks that the text itself doesn't hold."""
    part = F.split(output, "<[PSM]>")
    return F.when(form == PSM, F.concat(part[1], part[3], part[2])).when(form == SPM, F.concat(part[2], part[3], part[1])).otherwise(output)
