"""Token counts of whole texts under a BPE vocabulary with word ends, merged rank by rank in numpy.

White space never enters a token of such a vocabulary, so texts are cut there, and each distinct piece is counted once per worker.
The distinct pre-tokens of a batch are one ragged array of symbols; in each round every sequence merges all places of its own
lowest-ranked pair, and sequences without a pair leave. What counts is the symbols left.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from .tokens import gathered
from .words import give_back

#: Symbols merged at a time; a sequence of more than LONG symbols is merged alone, by a heap of ranks.
AT_ONCE, LONG = 1 << 19, 256
NO_RANK = np.iinfo(np.int64).max
RESULT = [StructField("n_bytes", LongType()), StructField("n_tokens", LongType()), StructField("over_limit", BooleanType())]
_counters: dict[str, TokenCounter] = {}


class TokenCounter:
    """Counts tokens of Arrow columns of texts; remembers the counts of pieces of at most `most` bytes in all between batches."""

    def __init__(self, path: str, most: int = 48 << 20) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        model = rules["model"]
        if [x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str("a b")] != ["a", "b"] or model["type"] != "BPE":
            raise ValueError("not a BPE vocabulary that drops white space")
        special = [x for x in rules["added_tokens"] if x["special"]]
        if any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in special):
            raise ValueError("special tokens that depend on their surroundings")
        names = sorted((x["content"] for x in special), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]]
        made: dict[str, int] = {}
        for rank, (a, b) in enumerate(pairs):
            if max(made.get(a, -1), made.get(b, -1)) >= rank or a + b in made:
                raise ValueError("a pair ranks before its parts: merging all places of a rank at once isn't exact")
            made[a + b] = rank
        self.size = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        self.rank = np.argsort(keys)
        self.keys = keys[self.rank]
        self.result = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.parts = {int(k): r for r, k in enumerate(keys)}
        # the library writes bytes as these characters; a symbol for each, alone and at the end of a word
        letters = [c for c in vocab if len(c) == 1]
        self.inner, self.last = (np.full(0x10000, -1, np.int64) for _ in range(2))
        for c in letters:
            self.inner[ord(c)], self.last[ord(c)] = vocab[c], vocab.get(c + end, -1)
        self.most, self.known, self.used = most, {}, 0

    def _long(self, symbols: np.ndarray) -> int:
        """Symbols left of one long sequence: ranks wait in a heap, all places of a rank are merged together, left to right."""
        own, n, get = symbols.tolist(), len(symbols), self.parts.get
        after, before, left, size = list(range(1, n + 1)), list(range(-1, n - 1)), n, self.size
        places: dict[int, list[int]] = {}
        for i in range(n - 1):
            rank = get(own[i] * size + own[i + 1])
            if rank is not None:
                places.setdefault(rank, []).append(i)
        ranks = list(places)
        heapify(ranks)
        while ranks:
            rank = heappop(ranks)
            result = int(self.result[rank])
            for i in sorted(places.pop(rank)):
                j = after[i]
                if own[i] < 0 or j >= n or get(own[i] * size + own[j]) != rank:
                    continue
                own[i], own[j], left = result, -1, left - 1
                after[i] = after[j]
                if after[j] < n:
                    before[after[j]] = i
                for k, m in ((before[i], i), (i, after[i])):
                    new = get(own[k] * size + own[m]) if k >= 0 and m < n else None
                    if new is not None:
                        if new not in places:
                            places[new] = []
                            heappush(ranks, new)
                        places[new].append(k)
        return left

    def _merged(self, symbols: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Symbols left of each of the sequences of `size` symbols (at least one) that stand end to end."""
        left, active, size = size.copy(), np.arange(len(size)), size.copy()
        while len(active):
            first = np.cumsum(size) - size
            row = np.repeat(np.arange(len(size)), size)
            key = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.full(len(symbols), NO_RANK)
            hit = np.flatnonzero((self.keys[at] == key) & (row[1:] == row[:-1]))
            rank[hit] = self.rank[at[hit]]
            lowest = np.minimum.reduceat(rank, first)
            chosen = (rank == lowest[row]) & (rank != NO_RANK)
            # places of one pair overlap only in runs of one symbol: every second one of a run, from its left
            place = np.flatnonzero(chosen)
            fresh = np.r_[True, np.diff(place) > 1]
            run = np.maximum.accumulate(np.where(fresh, place, 0)) if len(place) else place
            place = place[(place - run) % 2 == 0]
            symbols[place] = self.result[rank[place]]
            stays = lowest[row] != NO_RANK
            stays[place + 1] = False
            size = size - np.bincount(row[place], minlength=len(size))
            left[active] = size
            going = lowest != NO_RANK
            symbols, size, active = symbols[stays], size[going], active[going]
        return left

    def symbols_left(self, pre_tokens: list[str]) -> np.ndarray:
        """The number of tokens of each pre-token (in the library's characters for bytes; none is empty)."""
        size = np.fromiter(map(len, pre_tokens), np.int64, len(pre_tokens))
        left, ends, i = np.zeros(len(size), np.int64), np.cumsum(size), 0
        while i < len(size):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + AT_ONCE, "right")))
            codes = np.frombuffer("".join(pre_tokens[i:j]).encode("utf-32-le"), np.uint32)
            symbols, own = self.inner[codes], size[i:j]
            closing = np.cumsum(own) - 1
            symbols[closing] = self.last[codes[closing]]
            if symbols.min() < 0:
                raise ValueError("a byte that the vocabulary doesn't have")
            long = np.flatnonzero(own > LONG)
            for k in long.tolist():
                left[i + k] = self._long(symbols[closing[k] + 1 - own[k] : closing[k] + 1])
            short = own <= LONG
            left[i:j][short] = self._merged(symbols[np.repeat(short, own)], own[short])
            i = j
        return left

    def _pre_tokens(self, text: str) -> list[tuple[str, tuple[int, int]]]:
        return self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text)

    def _learn(self, pieces: list[str]) -> np.ndarray:
        """Counts of new pieces (without ASCII white space). Those without a special token go through the library's normalizer
        and pre-tokenizer many at a time, a space between them; ASCII ones alone keep their lengths there."""
        counts = np.zeros(len(pieces), np.int64)
        found: dict[str, int] = {}
        numbers, owners = [], []

        def add(split: list, owner) -> None:
            for word, _ in split:
                numbers.append(found.setdefault(word, len(found)))
            owners.append(owner)

        simple = []
        for i, x in enumerate(pieces):
            if self.special and self.special.search(x):
                counts[i] += len(self.special.findall(x))
                for part in self.special.split(x):
                    split = self._pre_tokens(part)
                    add(split, np.full(len(split), i))
            elif x.isascii():
                if x:  # two spaces in a row would become one, and move what follows
                    simple.append(i)
            else:
                split = self._pre_tokens(x)
                add(split, np.full(len(split), i))
        for k in range(0, len(simple), 500):
            some = np.array(simple[k : k + 500])
            begins = np.cumsum([0, *(len(pieces[i]) + 1 for i in some)])
            split = self._pre_tokens(" ".join(pieces[i] for i in some))
            at = np.fromiter((b for _, (b, _) in split), np.int64, len(split))
            add(split, some[np.searchsorted(begins, at, "right") - 1])
        if found:
            left = self.symbols_left(list(found))
            counts += np.bincount(np.concatenate(owners), left[np.array(numbers)], len(pieces)).astype(np.int64)
        return counts

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; null counts as empty."""
        if not len(texts):
            return np.zeros(0, np.int64)
        cut = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        bounds = cut.offsets.to_numpy().astype(np.int64)
        coded = cut.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        if self.used > self.most:
            self.known, self.used = {}, 0
        new = [x for x in pieces if x not in self.known]
        fresh = dict(zip(new, self._learn(new).tolist(), strict=True))
        number = np.fromiter((self.known[x] if x in self.known else fresh[x] for x in pieces), np.int64, len(pieces))
        for x, n in fresh.items():
            if len(x) <= 256:
                self.known[x] = n
                self.used += 100 + len(x)
        total = np.r_[0, np.cumsum(number[coded.indices.to_numpy(zero_copy_only=False)])]
        return np.diff(total[bounds - bounds[0]])


def counter(path: str) -> TokenCounter:
    """One counter per worker process and vocabulary file."""
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def _counted(vocabulary: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary)
        for table in gathered(batches, text="_count_text"):
            table = table.combine_chunks()
            text = table["_count_text"].chunk(0)
            n = own.count(text)
            size = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            kept = table.column_names[:-1]
            yield pa.RecordBatch.from_arrays([*(table[c].chunk(0) for c in kept), size, pa.array(n), pa.array(n > limit)], names=[*kept, *(f.name for f in RESULT)])
        own.known, own.used = {}, 0
        give_back()

    return run


def token_counts(documents: DataFrame, vocabulary: str, limit: int = 2048, keep: tuple[str, ...] = ("doc_id",), text_column: str = "text") -> DataFrame:
    """Per row: the columns in `keep`, n_bytes (UTF-8), n_tokens, over_limit (more tokens than `limit`), of the whole text.

    Counts are those of the library on the file `vocabulary`, special strings inside texts being one token each, without added
    ones. Null and empty texts, and white space alone, have none. Repeated rows get equal values, an empty table gives an empty
    one, nothing is shuffled. Columns of `keep` must not be named as those of the result.
    """
    clash = sorted({*keep} & {"_count_text", *(f.name for f in RESULT)})
    if clash:
        raise ValueError(f"columns named as the result's: {', '.join(clash)}")
    docs = documents.select(*keep, F.col(text_column).cast("string").alias("_count_text"))
    return docs.mapInArrow(_counted(vocabulary, limit), StructType([*docs.schema.fields[:-1], *RESULT]))
