"""Token ids of whole texts by the `tokenizers` library, inside tasks.

Byte-level BPE never merges across the boundary before a single space that stands next to a non-space on at least one side,
so texts are cut there (Arrow splits and numbers the distinct pieces of a batch), each distinct piece is encoded by the library
once per worker, and the ids are those of the whole text. Texts with a space between two white-space characters are encoded whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import give_back

_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_INNER = f"{_WHITE} {_WHITE}"
_encoders: dict[str, Encoder] = {}


def _plain(piece: str) -> bool:
    """A run of letters that all Unicode versions call letters: one pre-token."""
    return piece.isalpha() and (piece.isascii() or max(piece) < "ɐ")


class _Store:
    """Piece -> number, and the ids of each number, end to end."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.starts, self.used = np.zeros(1 << 16, np.uint16), [np.zeros(1, np.int64)], 0

    def add(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.number)
        self.number.update(zip(pieces, range(n, n + len(pieces)), strict=True))
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), self.ids.dtype)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts.append(self.used + np.cumsum(sizes))
        self.used += len(ids)

    def offsets(self) -> np.ndarray:
        self.starts = [np.concatenate(self.starts)]
        return self.starts[0]


class Encoder:
    """Encodes Arrow columns of texts; keeps the ids of at most `most` pieces between batches. For vocabularies below 65536 ids."""

    def __init__(self, path: str, most: int = 500_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        def load():
            t = Tokenizer.from_file(path)
            t.encode_special_tokens = True  # their strings in a text are ordinary text
            return t

        self.tokenizer, self.letters = load(), load()
        # for runs of letters after a space: the same model, cut at the space only
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False), pre_tokenizers.Split("Ġ", "merged_with_next")])
        self.starts_piece = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.starts_piece[i] = token.startswith("Ġ")
        self.most, self.store = most, _Store()

    def _lists(self, tokenizer, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter((i for x in lists for i in x), np.uint16, int(sizes.sum())), sizes

    def _learn(self, pieces: list[str]) -> None:
        """Ids of new pieces, each preceded by a space; many go through the library as one text."""
        kinds: tuple[list[str], list[str], list[str]] = ([], [], [])
        for p in pieces:
            kinds[0 if _plain(p) else 2 if not p or p[0].isspace() or p[-1].isspace() else 1].append(p)
        for tokenizer, own in ((self.letters, kinds[0]), (self.tokenizer, kinds[1])):
            if own:
                ids, _ = self._lists(tokenizer, [" " + " ".join(own[k : k + 200]) for k in range(0, len(own), 200)])
                self.store.add(own, ids, np.diff(np.r_[np.flatnonzero(self.starts_piece[ids]), len(ids)]))
        if kinds[2]:
            self.store.add(kinds[2], *self._lists(self.tokenizer, [" " + p for p in kinds[2]]))

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        known = self.store.number
        self._learn([p for p in pieces if p not in known])
        return np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        cut = pc.split_pattern(texts, " ")
        bounds = cut.offsets.to_numpy().astype(np.int64)
        coded = cut.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        bounds = bounds - bounds[0]
        at = self._numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        offsets = self.store.offsets()
        begin, sizes = offsets[at], offsets[at + 1] - offsets[at]
        head_ids, head_sizes = self._lists(self.tokenizer, coded.dictionary.take(coded.indices.take(pa.array(bounds[:-1]))).to_pylist())
        sizes[bounds[:-1]] = head_sizes
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.store.ids[np.minimum(np.repeat(begin - (ends - sizes), sizes) + np.arange(total), len(self.store.ids) - 1)]
        heads = np.r_[0, np.cumsum(head_sizes)]
        first = np.r_[0, ends][bounds]
        ids[np.repeat(first[:-1] - heads[:-1], head_sizes) + np.arange(len(head_ids))] = head_ids
        return ids, first

    def encode(self, texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint16) of all texts, and the first of each (one more than texts). Null counts as empty."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not len(texts):
            return np.zeros(0, np.uint16), np.zeros(1, np.int64)
        if len(self.store.number) > self.most:
            self.store = _Store()
        whole = np.flatnonzero(pc.match_substring_regex(texts, _INNER).to_numpy(zero_copy_only=False))
        if not len(whole):
            return self._cut(texts)
        is_whole = np.zeros(len(texts), bool)
        is_whole[whole] = True
        rest = np.flatnonzero(~is_whole)
        parts = self._cut(texts.take(pa.array(rest))) if len(rest) else (np.zeros(0, np.uint16), np.zeros(1, np.int64))
        own_ids, own_sizes = self._lists(self.tokenizer, texts.take(pa.array(whole)).to_pylist())
        size, begin = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        size[rest], begin[rest] = np.diff(parts[1]), parts[1][:-1]
        size[whole], begin[whole] = own_sizes, len(parts[0]) + np.cumsum(own_sizes) - own_sizes
        ends = np.cumsum(size)
        return np.concatenate([parts[0], own_ids])[np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]))], np.r_[0, ends]


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget(path: str) -> None:
    """Drops the pieces that the worker keeps; at the end of a task, as the next one of this worker may need the memory."""
    encoder(path).store = _Store()
    give_back()


def gathered(batches, most_bytes: int = 6 << 20, text: str = "text"):
    """Arrow batches joined, or cut, to about most_bytes of text: a piece is looked up once for many rows, and few rows are held."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            before = int(ends[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + most_bytes - size, "right")))
            held.append(batch.slice(begin, end - begin))
            size += int(ends[end - 1]) - before
            begin = end
            if size >= most_bytes or begin < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)
