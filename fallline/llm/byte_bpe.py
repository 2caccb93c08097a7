"""Byte-level BPE: encoding and decoding.

Pre-tokenisation uses no regular expression.  Each code point gets a class from a table; a small
automaton over these classes says where a piece begins.  What one character does to the automaton is
a function on its states, and functions compose associatively, so the states before all characters
come from a blocked scan of compositions (the compositions themselves are entries of a table, since
only a few dozen different ones can arise).  The pieces partition the text, so their offsets alone
make them an Arrow array over the block's bytes; its distinct values go through cached pair merging.

Defined results for odd input: null encodes as the empty text (no ids); repeated and tied rows encode
alike; an empty table gives an empty table; a text of any length is encoded whole; columns that clash
with the output's names are left out of it.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from fallline.llm.rows import hold, per_batch, per_partition
from fallline.llm.textblock import Block, binary_array, blocks, ranges

# Symbols: what one code point means to the automaton, looking one or two code points ahead.
LETTER, NUMBER, OTHER, SUFFIX1, SUFFIX2, SPACE_BEFORE, BLANK_BEFORE, BLANK_RUN = range(8)
# States: what has been read of the current piece.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_BLANKS, ONE_LEFT, TWO_LEFT = range(8)

#: Pieces longer than this many bytes are merged with a heap.
LONG_PIECE = 256
#: Pieces, and bytes of pieces, that one worker keeps from block to block.
CACHE_PIECES, CACHE_BYTES = 200_000, 16 << 20
#: Bytes of text that are encoded together: more repeat more pieces.
TEXT_BYTES = 2 << 20


def _step(state: int, symbol: int) -> tuple[bool, int]:
    """Whether a piece begins at this character, and the state after it."""
    if state == TWO_LEFT:
        return False, ONE_LEFT
    if state == ONE_LEFT:
        return False, FRESH
    run = {IN_LETTERS: (LETTER,), IN_NUMBERS: (NUMBER,), IN_OTHERS: (OTHER, SUFFIX1, SUFFIX2), IN_BLANKS: (BLANK_RUN,)}
    if symbol in run.get(state, ()):
        return False, state
    if state == AFTER_SPACE:
        return False, {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS}.get(symbol, IN_OTHERS)
    begun = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, SUFFIX1: ONE_LEFT, SUFFIX2: TWO_LEFT,
             SPACE_BEFORE: AFTER_SPACE, BLANK_BEFORE: FRESH, BLANK_RUN: IN_BLANKS}
    return True, begun[symbol]


@lru_cache(1)
def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index of each symbol's function, composition table, value table, begins table).

    Symbols 8 to 15 are symbols 0 to 7 at the beginning of a text, where any state counts as FRESH.
    """
    functions = [tuple(_step(FRESH if s >= 8 else state, s % 8)[1] for state in range(8)) for s in range(16)]
    known = {f: i for i, f in enumerate(dict.fromkeys([*functions, tuple(range(8))]))}
    todo = list(known)
    while todo:  # the closure under composition
        f = todo.pop()
        for g in list(known):
            for h in (tuple(g[x] for x in f), tuple(f[x] for x in g)):
                if h not in known:
                    known[h] = len(known)
                    todo.append(h)
    assert len(known) < 65536
    listed = list(known)
    compose = np.array([[known[tuple(g[x] for x in f)] for g in listed] for f in listed], dtype=np.uint16)
    begins = np.array([[s >= 8 or _step(state, s)[0] for s in range(16)] for state in range(8)])
    return np.array([known[f] for f in functions], dtype=np.uint16), compose, np.array(listed, dtype=np.uint8), begins


def scan_states(symbols: np.ndarray, width: int = 64) -> np.ndarray:
    """The state before each character: an exclusive scan of the symbols' functions."""
    of_symbol, compose, value, _ = _automaton()
    identity = next(i for i, f in enumerate(value) if (f == np.arange(8)).all())

    def scan(function: np.ndarray) -> np.ndarray:  # composition of all functions before each place
        n = len(function)
        rows = -(-n // width)
        grid = np.full(rows * width, identity, dtype=np.uint16)
        grid[:n] = function
        grid = grid.reshape(rows, width).T.copy()
        inside = np.empty_like(grid)
        running = np.full(rows, identity, dtype=np.uint16)
        for k in range(width):
            inside[k] = running
            running = compose[running, grid[k]]
        if rows > 1:
            inside = compose[scan(running)[None, :], inside]
        return inside.T.reshape(-1)[:n]

    return value[scan(of_symbol[symbols]), FRESH]


@lru_cache(1)
def _classes() -> np.ndarray:
    """0 letter, 1 number, 2 other, 3 white space, for every code point."""
    table = np.full(0x110000, 2, dtype=np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            table[c] = "LN".index(kind)
    # The Unicode property White_Space.
    table[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 3
    return table


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, byte position of each) of UTF-8 bytes."""
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    if len(at) == len(data):
        return data.astype(np.uint32), at
    pad = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
    b = pad[at]
    size = np.ones(len(at), np.uint8) + (b >= 0xC0) + (b >= 0xE0) + (b >= 0xF0)
    points = np.where(size == 1, b, b & (0xFF >> (size + 1)))
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        points[more] = points[more] << 6 | (pad[at[more] + k] & 0x3F)
    return points, at


def pieces(block: Block) -> np.ndarray:
    """Byte offsets of the pieces of a block's texts; they follow each other without gaps."""
    data = block.data
    if not len(data):
        return np.zeros(1, dtype=np.int64)
    points, at = code_points(data)
    n = len(points)
    kind = _classes()[points]
    first = np.zeros(n + 1, dtype=bool)
    first[np.searchsorted(at, block.offsets)] = True  # the beginning of a text, or the end of the last
    symbols = kind.copy()
    blank = kind == 3
    followed = np.zeros(n, dtype=bool)  # by a character of the same text that is not white space
    followed[:-1] = ~blank[1:] & ~first[1:-1]
    symbols[blank] = BLANK_RUN
    symbols[blank & followed] = BLANK_BEFORE
    symbols[blank & followed & (points == 0x20)] = SPACE_BEFORE
    quote = np.flatnonzero(points == 0x27)
    if len(quote):
        pad = np.concatenate([points, np.zeros(2, points.dtype)])
        alone = ~first[quote + 1]
        one, two = pad[quote + 1], pad[quote + 2]
        letter = np.isin(one, [ord(c) for c in "stmd"]) & alone
        pair = np.isin(one << 8 | two, [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")]) & alone & (two < 256) & ~first[np.minimum(quote + 2, n)]
        symbols[quote[letter]] = SUFFIX1
        symbols[quote[pair]] = SUFFIX2
    symbols[first[:-1]] += 8
    begins = _automaton()[3][scan_states(symbols), symbols]
    return np.append(at[begins], len(data)).astype(np.int64)


class Vocabulary:
    """The ranks of a byte-level BPE with cached pair merging."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.tokens = pa.array(tokens, pa.large_binary())
        self.token_bytes = np.array([len(t) for t in tokens], dtype=np.int64)
        self.decimals = pa.array([b"%d " % i for i in range(size)], pa.large_binary())
        self._forget()

    def _forget(self) -> None:
        self.slot: dict[bytes, int] = {}  # piece -> its place in the next two
        self.slot_bytes = 0
        self.first = self.size = np.empty(0, np.int64)
        self.ids = np.empty(0, np.int32)

    def _learn(self, new: list[bytes]) -> None:
        """Merge pieces and keep their ids."""
        found = [self.merge(piece) for piece in new]
        size = np.fromiter(map(len, found), np.int64, len(found))
        base, known = len(self.ids), len(self.size)
        self.slot.update(zip(new, range(known, known + len(new))))
        self.slot_bytes += sum(map(len, new))
        self.first = np.concatenate([self.first, base + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, np.fromiter((i for ids in found for i in ids), np.int32, int(size.sum()))])

    def merge(self, piece: bytes) -> list[int]:
        """Merge the adjacent pair of lowest rank, the leftmost first, until no pair has a rank."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        if len(piece) > LONG_PIECE:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best = min((r for r in pairs if r is not None), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1])
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i])

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap and a linked list: n log n in the piece's length."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # part i is piece[i:end[i]]; 0: merged away
        before = list(range(-1, n - 1))
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and end[i] < n and (r := ranks.get(piece[i : end[end[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[end[i]]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, to = heapq.heappop(heap)
            if not end[i] or end[i] == n or end[end[i]] != to:
                continue
            end[end[i]], end[i] = 0, to
            if to < n:
                before[to] = i
            offer(i)
            offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of the block, offsets of each text's ids)."""
        bounds = pieces(block)
        if len(bounds) == 1:
            return np.empty(0, np.int64), np.zeros(len(block) + 1, np.int64)
        coded = binary_array(block.data, bounds).dictionary_encode()
        if len(self.slot) > CACHE_PIECES or self.slot_bytes > CACHE_BYTES:
            self._forget()
        distinct = coded.dictionary.to_pylist()
        new = [piece for piece in distinct if piece not in self.slot]
        if new:
            self._learn(new)
        slot = np.fromiter(map(self.slot.__getitem__, distinct), np.int64, len(distinct))
        index = slot[coded.indices.to_numpy(zero_copy_only=False)]
        length = self.size[index]
        ids = self.ids[ranges(self.first[index], length)].astype(np.int64)
        before = np.concatenate([[0], np.cumsum(length)])
        return ids, before[np.searchsorted(bounds, block.offsets)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids, offsets of each id's bytes)."""
        out = np.concatenate([[0], np.cumsum(self.token_bytes[ids])])
        return _bytes_of(self.tokens.take(pa.array(ids))), out


def _bytes_of(array: pa.Array) -> np.ndarray:
    _, offsets, data = array.buffers()
    if data is None or not len(array):
        return np.empty(0, np.uint8)
    offsets = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 token and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(load_ranks(path))


hold(__name__, vocabulary.cache_clear)


def encode(df: DataFrame, ranks_path: str, *, key: str = "doc_id", text: str = "text", verify: bool = False) -> DataFrame:
    """key and ids (array of int) of every text.  ``ranks_path`` is read on the executors, where the
    vocabulary package is installed like the other libraries.  ``verify`` decodes the ids again and fails
    where the bytes differ."""

    def run(batches):
        vocab = vocabulary(ranks_path)
        for batch in batches:
            for block in blocks(batch.column("text"), TEXT_BYTES):
                ids, offsets = vocab.encode(block)
                if verify and not np.array_equal(vocab.decode(ids)[0], block.data):
                    raise ValueError("decoded bytes differ from the text")
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield {"key": batch.column("key").slice(block.first, len(block)), "ids": lists}

    rows = df.select(df[key].alias("key"), df[text].alias("text"))
    out = per_partition(rows, run, f"key {df.schema[key].dataType.simpleString()}, ids array<int>")
    return out.withColumnRenamed("key", key)


def decode(df: DataFrame, ranks_path: str, *, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, decoded (binary) and token_starts (byte offset of each token) of every list of ids."""

    def run(batch: pa.RecordBatch) -> dict:
        vocab = vocabulary(ranks_path)
        data, starts = [], []
        for row in batch.column("ids").to_pylist():
            row = np.array(row or [], dtype=np.int64)
            out, at = vocab.decode(row)
            data.append(out.tobytes())
            starts.append(at[:-1])
        return {"key": batch.column("key"), "decoded": pa.array(data, pa.binary()), "token_starts": pa.array(starts, pa.list_(pa.int64()))}

    rows = df.select(df[key].alias("key"), df[ids].alias("ids"))
    out = per_batch(rows, run, f"key {df.schema[key].dataType.simpleString()}, decoded binary, token_starts array<bigint>")
    return out.withColumnRenamed("key", key)


def digests(df: DataFrame, ranks_path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every text, decode its ids, and return key, n_tokens and SHA-256 of the decimal ids and of
    the decoded bytes, without sending the ids themselves back through Arrow."""

    def run(batch: pa.RecordBatch) -> dict:
        vocab = vocabulary(ranks_path)
        counts, ids_hash, text_hash = [], [], []
        for block in blocks(batch.column("text"), TEXT_BYTES):
            ids, offsets = vocab.encode(block)
            decoded, at = vocab.decode(ids)
            spelled = vocab.decimals.take(pa.array(ids))
            spelled_at = np.concatenate([[0], np.cumsum(_digits(ids) + 1)])
            spelled = _bytes_of(spelled)
            decoded, spelled = memoryview(decoded), memoryview(spelled)
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                counts.append(b - a)
                ids_hash.append(hashlib.sha256(spelled[spelled_at[a] : max(spelled_at[a], spelled_at[b] - 1)]).hexdigest())
                text_hash.append(hashlib.sha256(decoded[at[a] : at[b]]).hexdigest())
        return {"key": batch.column("key"), "n_tokens": counts, "ids_sha256": ids_hash, "decoded_sha256": text_hash}

    rows = df.select(df[key].alias("key"), df[text].alias("text"))
    out = per_batch(rows, run, f"key {df.schema[key].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("key", key)


def _digits(ids: np.ndarray) -> np.ndarray:
    """Decimal digits of each id."""
    return 1 + sum((ids >= 10**k).astype(np.int64) for k in range(1, 7))

