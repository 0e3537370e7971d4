"""Encoding of a whole corpus with a public byte-level BPE vocabulary, by replay of its merges.

Texts are cut into words by the vocabulary's pattern; each distinct word of a share of the corpus is encoded once. All
of them together form one array of symbols with links to their neighbours, and an inverted index from token pair to
positions. Merges are applied in rank order to all positions of a pair at once, and only the pairs left and right of a
merge enter the index anew. A merge's result is only part of later merges, so one pass over the ranks is enough.
"""

from __future__ import annotations

import base64
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.session import ship

#: Where the vocabulary files lie, if the caller does not say.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")

# Fixed value: the published pattern that cuts text into words before the merges of the 50k byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# The white space of the Unicode property of that name.
_SPACES = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_LETTER, _NUMBER, _OTHER, _SPACE, _STOP = range(5)


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of every code point."""
    kinds = {"L": _LETTER, "N": _NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[list(_SPACES)] = _SPACE
    return table


def word_starts(code: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Where PATTERN starts a word, for texts joined by one stop character each (flagged in ``stop``, also at the end).

    A word is a run of one class of characters, with a blank before it if there is one. A run of white space before a
    word loses its last character, which is the word's blank or a word of its own. A contraction is an apostrophe that
    begins a word, with its letters.
    """
    kind = _classes()[code]
    kind[stop] = _STOP
    change = np.empty(len(kind), bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    start = change | stop
    # the last white space before a word starts one; the word follows without a start of its own after a blank
    into = np.flatnonzero(change[1:] & (kind[:-1] == _SPACE) & (kind[1:] != _STOP))
    start[into] = True
    start[into[code[into] == 0x20] + 1] = False
    mark = np.flatnonzero((code[:-1] == 0x27) & change[:-1] & (kind[1:] == _LETTER))
    mark = mark[(mark == 0) | (code[mark - 1] != 0x20)]
    one = code[mark + 1]
    two = code[np.minimum(mark + 2, len(code) - 1)]
    short = np.isin(one, [ord(x) for x in "stmd"])
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    for at, size in ((mark[short], 2), (mark[long], 3)):
        start[at + 1] = False
        after = at + size
        start[after[kind[after] == _LETTER]] = True
    return start


def words_of(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(data, places, lengths, counts): UTF-8 bytes, where in them the words of all texts lie, and how many each text has."""
    joined = "\n".join(texts) + "\n"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
    stop = np.zeros(len(code), bool)
    stop[ends] = True
    at = np.flatnonzero(word_starts(code, stop))
    place, data = at, joined.encode("utf-8", "replace")
    if len(data) > len(code):
        wide = np.flatnonzero(code >= 0x80)
        some = code[wide]
        more = np.concatenate(([0], np.cumsum(1 + (some >= 0x800).astype(np.int64) + (some >= 0x10000))))
        place = at + more[np.searchsorted(wide, at)]
    is_word = ~stop[at]
    length = np.diff(np.append(place, len(data)))[is_word]
    return data, place[is_word], length, np.diff(np.searchsorted(at[is_word], np.concatenate(([0], ends))))


def numbered(data: bytes, place: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(numbers, words): a number for each place, and the distinct words by number.

    Words of up to 7 bytes are compared as one integer that holds bytes and length, those of up to 15 as a pair, longer
    ones as they are: exact in each case.
    """
    numbers, words = np.empty(len(place), np.int64), []
    padded = data + bytes(16)
    view = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    masks = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)

    def take(which: np.ndarray, codes: np.ndarray, n: int) -> None:
        first = np.empty(n, np.int64)
        first[codes[::-1]] = which[::-1]
        numbers[which] = codes + len(words)
        words.extend(data[a : a + k] for a, k in zip(place[first].tolist(), length[first].tolist()))

    short = np.flatnonzero(length <= 7)
    if len(short):
        size = length[short]
        codes, found = pd.factorize((view[place[short]] & masks[size]) | (size.astype(np.uint64) << np.uint64(56)))
        take(short, codes, len(found))
    middle = np.flatnonzero((length > 7) & (length <= 15))
    if len(middle):
        size = length[middle] - 8
        low, _ = pd.factorize(view[place[middle]])
        high, _ = pd.factorize((view[place[middle] + 8] & masks[size]) | (size.astype(np.uint64) << np.uint64(56)))
        codes, found = pd.factorize((low.astype(np.int64) << 32) | high)
        take(middle, codes, len(found))
    rest = np.flatnonzero(length > 15)
    if len(rest):
        index = _Index()
        codes = np.array([index[data[a : a + k]] for a, k in zip(place[rest].tolist(), length[rest].tolist())], np.int64)
        take(rest, codes, len(index))
    return numbers, words


class _Index(dict):
    """Numbers words in order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = k = len(self)
        return k


class Merges:
    """A vocabulary as byte ids, and its merges as sorted pair codes with rank and result."""

    def __init__(self, path: str):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb") if line.strip())}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        codes, results = [], []
        for word, rank in ranks.items():
            if len(word) > 1 and (pair := self._parts(word, rank, ranks)):
                codes.append((pair[0] << 32) | pair[1])
                results.append(rank)
        order = np.argsort(np.array(codes, np.int64))
        self.codes, self.results = np.array(codes, np.int64)[order], np.array(results, np.int32)[order]
        self.size = max(ranks.values()) + 1

    @staticmethod
    def _parts(word: bytes, rank: int, ranks: dict[bytes, int]) -> tuple[int, int] | None:
        """The two tokens whose merge made ``word``: what is left of its bytes after all earlier merges."""
        parts = [bytes([b]) for b in word]
        while len(parts) > 2:
            best, at = min(((ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1)))
            if best >= rank:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return ranks[parts[0]], ranks[parts[1]]

    def found(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The result of each pair's merge, -1 for pairs without."""
        code = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.results[at], -1)

    def pair(self) -> dict[int, tuple[int, int]]:
        return {int(r): (int(c) >> 32, int(c) & 0xFFFFFFFF) for c, r in zip(self.codes, self.results)}

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all words one after another, and where each word's end."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        n = int(ends[-1]) if len(words) else 0
        if not n:
            return np.zeros(0, np.int32), ends
        sym = np.empty(n + 1, np.int32)
        sym[:n] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        sym[n] = -1  # a stop beyond the last word
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        first, last = ends - lengths, ends - 1
        filled = lengths > 0
        after[last[filled]] = n
        before[first[filled]] = n
        alive = np.ones(n + 1, bool)
        alive[n] = False
        index: list[list[np.ndarray] | None] = [None] * self.size

        def enter(at: np.ndarray) -> None:
            """Files the pairs that start at these positions under their merge."""
            to = self.found(sym[at], sym[after[at]])
            hit = to >= 0
            if not hit.any():
                return
            at, to = at[hit], to[hit]
            order = np.argsort(to, kind="stable")
            at, to = at[order], to[order]
            cuts = np.flatnonzero(np.diff(to)) + 1
            for rank, some in zip(to[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts) if len(cuts) else [at]):
                if index[rank] is None:
                    index[rank] = [some]
                else:
                    index[rank].append(some)

        everywhere = np.arange(n, dtype=np.int32)
        enter(everywhere[after[:n] != n])
        pair = self.pairs
        for rank in range(self.size):
            filed = index[rank]
            if filed is None:
                continue
            index[rank] = None
            a, b = pair[rank]
            at = filed[0] if len(filed) == 1 else np.unique(np.concatenate(filed))
            at = at[alive[at] & (sym[at] == a)]
            at = at[sym[after[at]] == b]
            if not len(at):
                continue
            if a == b and len(at) > 1:
                at = self._apart(np.sort(at), after)
            gone = after[at]
            sym[at] = rank
            alive[gone] = False
            right = after[gone]
            after[at] = right
            inside = right != n
            before[right[inside]] = at[inside]
            left = before[at]
            left = left[left != n]
            near = np.concatenate((left, at[inside]))
            if len(near):
                enter(np.unique(near) if len(near) > 1 else near)
        counts = np.concatenate(([0], np.cumsum(alive[:n])))
        return sym[:n][alive[:n]], counts[ends]

    @property
    def pairs(self) -> dict[int, tuple[int, int]]:
        if not hasattr(self, "_pairs"):
            self._pairs = self.pair()
        return self._pairs

    @staticmethod
    def _apart(at: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Of positions of a pair of equal tokens, those taken from the left without overlap."""
        chained = after[at[:-1]] == at[1:]
        if not chained.any():
            return at
        run = np.arange(len(at)) - np.maximum.accumulate(np.where(np.concatenate(([True], ~chained)), np.arange(len(at)), 0))
        return at[run % 2 == 0]


class Encoder:
    """Encodes texts by groups, and keeps the ids of the words met so far up to a bound."""

    def __init__(self, merges: Merges, keep_words: int = 1_000_000):
        self.merges, self.keep_words = merges, keep_words
        self._reset()

    def _reset(self) -> None:
        self.index, self.done = _Index(), 0
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts; null and empty texts have no ids."""
        if len(self.index) > self.keep_words:
            self._reset()
        data, place, length, counts = words_of([t or "" for t in texts])
        numbers, distinct = numbered(data, place, length)
        words = np.array([self.index[w] for w in distinct], np.int64)[numbers]
        if len(self.index) > self.done:
            ids, ends = self.merges.replay(list(self.index)[self.done :])
            base = len(self.flat)
            self.flat, self.ends, self.done = np.concatenate((self.flat, ids)), np.concatenate((self.ends, ends + base)), len(self.index)
        ends = self.ends[words]
        starts = np.where(words > 0, self.ends[words - 1], 0) if len(words) else ends
        lengths = ends - starts
        stops = np.cumsum(lengths)
        spots = np.arange(int(stops[-1]) if len(stops) else 0, dtype=np.int64) + np.repeat(starts - (stops - lengths), lengths)
        total = np.concatenate(([0], stops))
        offsets = total[np.concatenate(([0], np.cumsum(counts)))]
        return self.flat[spots], offsets


_SHARED: dict[str, Merges] = {}


def _merges(path: str) -> Merges:
    """One vocabulary for each worker process."""
    if path not in _SHARED:
        _SHARED[path] = Merges(path)
    return _SHARED[path]


def _encoder(path: str, group_chars: int, count_only: bool):
    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list]]:
        """(other columns, texts) of about ``group_chars`` characters, cut between rows."""
        held, texts, size = [], [], 0
        for batch in batches:
            rest, some, at = batch.drop_columns("text"), batch["text"].to_pylist(), 0
            for k, t in enumerate(some):
                size += len(t or "")
                if size >= group_chars:
                    yield pa.Table.from_batches([*held, rest.slice(at, k + 1 - at)]), texts + some[at : k + 1]
                    held, texts, size, at = [], [], 0, k + 1
            held.append(rest.slice(at))
            texts += some[at:]
        if texts:
            yield pa.Table.from_batches(held), texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(_merges(path))
        for rest, texts in groups(batches):
            flat, offsets = encoder.encode(texts)
            if count_only:
                yield from rest.append_column("n_tokens", pa.array(np.diff(offsets), pa.int64())).combine_chunks().to_batches()
                continue
            at = 0
            while at < len(texts):  # batches of a bounded number of ids
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + 4_000_000, "right")) - 1)
                part = pa.ListArray.from_arrays(pa.array((offsets[at : to + 1] - offsets[at]).astype(np.int32)), pa.array(flat[offsets[at] : offsets[to]]))
                yield from rest.slice(at, to - at).append_column("ids", part).combine_chunks().to_batches()
                at = to

    return run


def encoded(documents: DataFrame, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS, key: str = "doc_id", text: str = "text", group_chars: int = 12_000_000) -> DataFrame:
    """(doc_id, ids): the ids of each whole text, without special tokens; one row for each row of ``documents``.

    Null, empty: no ids (an empty list). Strings of special tokens in a text are ordinary text. Rows are read in place:
    nothing is shuffled, and each distinct word of a group of texts is encoded once.
    """
    ship(documents.sparkSession)
    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_encoder(f"{folder}/{vocabulary}.tiktoken", group_chars, False), "doc_id long, ids array<int>")


def token_counts(documents: DataFrame, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS, key: str = "doc_id", text: str = "text", keep: str | None = None, group_chars: int = 12_000_000) -> DataFrame:
    """(doc_id[, keep], n_tokens) of each text; 0 for null and empty texts. ``keep`` names a text column to pass on."""
    others = [F.col(keep).cast("string").alias("kept")] if keep else []
    ship(documents.sparkSession)
    rows = documents.select(F.col(key).cast("long").alias("doc_id"), *others, F.col(text).alias("text"))
    out = rows.mapInArrow(_encoder(f"{folder}/{vocabulary}.tiktoken", group_chars, True), "doc_id long, " + "kept string, " * bool(keep) + "n_tokens long")
    return out.withColumnRenamed("kept", keep) if keep else out


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = {int(b): base64.b64decode(a) for a, b in (line.split() for line in open(path, "rb") if line.strip())}
        table = [ranks.get(k, b"") for k in range(max(ranks) + 1)]
        width = np.array([len(w) for w in table], np.int64)
        for batch in batches:
            ids = batch["ids"]
            flat, ends = ids.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
            at = np.concatenate(([0], np.cumsum(width[flat])))[ends]
            data = b"".join(map(table.__getitem__, flat.tolist()))
            column = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], column.cast(pa.binary())], ["doc_id", "data"])

    return run


def decoded(ids: DataFrame, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, data): the bytes that lists of ids stand for; empty for empty and null lists."""
    ship(ids.sparkSession)
    return ids.select("doc_id", "ids").mapInArrow(_decoder(f"{folder}/{vocabulary}.tiktoken"), "doc_id long, data binary")
