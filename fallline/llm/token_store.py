"""Token ids in Parquet files.

A store is a folder of Parquet files in ascending key order, one row a document: its key, the number
of its ids, the number of the part it was written in (a part is what one task wrote, in one file or more), the number of
ids before it in its part, and the ids as a list column.  The id column is
dictionary encoded (ids repeat, and a page then holds them in as many bits as its dictionary needs);
keys and counts are delta encoded.  Row groups and pages have a bounded size and the column and offset
indexes are written, so a reader that wants some keys, or the metadata alone, skips the other pages.

Encoding splits texts at ASCII white space, encodes each distinct word once and keeps it in a bounded
cache; this needs a tokenizer whose words never reach across white space, which :func:`splits_at_space`
checks from the tokenizer's file.  For any other tokenizer whole texts are encoded, and so are texts that spell one of the
tokenizer's special tokens: the tokenizer takes such a string for the token.

Defined results for odd input: a null text is the empty text and has the end id alone; a text of any length is encoded
whole, one block of texts in memory at a time; a null key
comes before all others; rows with equal keys stand next to each other in an order fixed by the hash of
their texts; an empty table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fallline.llm.rows import hold, per_partition
from fallline.llm.textblock import IS_SPACE, LOWER, Block, binary_array, blocks
from fallline.runtime import broadcast_if_small

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2_000
CACHE_WORDS = 400_000
#: Parts words that are encoded together.
MARK = "\x01"
#: Texts of a thousand new words that the tokenizer gets at once: what it returns is a hundred times larger than the ids.
AT_ONCE = 16
#: Bytes of text that are encoded together: more repeat more words.
TEXT_BYTES = 8 << 20


def splits_at_space(tokenizer_json: str) -> bool:
    """Whether the tokenizer drops white space and lets no word reach across it."""
    spec = json.loads(tokenizer_json)
    normal = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return normal == ["NFC", "Replace", "Lowercase"] and first.get("behavior") == "Removed" and bool(first.get("invert"))


_CLASS = np.full(256, 4, dtype=np.uint8)  # anything else
_CLASS[[c for c in range(256) if chr(c).isascii() and chr(c).isalpha()]] = 1
_CLASS[[ord(c) for c in "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"]] = 2  # no apostrophe: it can begin a suffix
_CLASS[IS_SPACE] = 0


def units(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes without white space, bounds of the units in them, number of units before each text).

    Units are words, cut further where an ASCII letter and an ASCII punctuation mark meet: there the tokenizer
    cuts too, and cut units repeat far more often than words.
    """
    kind = _CLASS[block.data]
    solid = kind != 0
    begins = solid.copy()
    if len(kind):
        begins[1:] &= ~solid[:-1] | ((kind[1:] ^ kind[:-1]) == 3)
        inner = block.offsets[1:-1]
        inner = inner[inner < len(kind)]
        begins[inner] = solid[inner]
    start = np.flatnonzero(begins)
    before = np.cumsum(solid, dtype=np.int32 if len(solid) < 1 << 31 else np.int64)  # a unit's first byte is counted
    bounds = np.append(before[start] - 1, before[-1] if len(before) else 0)
    return block.data[solid], bounds, np.searchsorted(start, block.offsets)


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task has one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = f.read()
        self.tokenizer = Tokenizer.from_str(spec)
        added = json.loads(spec).get("added_tokens") or []
        self.special = [t["content"].encode() for t in added]
        # Other kinds of added tokens reach across what stands around them.
        plain = not any(t.get("normalized") or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added)
        self.by_word = plain and splits_at_space(spec)
        self._forget()
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None

    def _forget(self) -> None:
        self.slot: dict[bytes, int] = {}  # word -> its place in the next two
        self.first = self.size = np.empty(0, np.int32)
        self.ids = np.empty(0, np.int32)

    def _learn(self, new: list[bytes]) -> None:
        """Encode words and keep their ids.  Many words go through the tokenizer as one text, parted by a mark that
        is a token of its own; words that hold the mark go alone."""
        mark = MARK.encode()
        alone = new if self.mark is None else [w for w in new if mark in w]
        together = [] if self.mark is None else [w for w in new if mark not in w] if alone else new
        sizes, flat = [], []
        between = b" " + mark + b" "
        texts = [between.join(together[i : i + 1000]).decode() for i in range(0, len(together), 1000)]
        for e in (e for i in range(0, len(texts), AT_ONCE) for e in self.tokenizer.encode_batch_fast(texts[i : i + AT_ONCE], add_special_tokens=False)):
            ids = np.array(e.ids, np.int32)
            marks = np.flatnonzero(ids == self.mark)
            sizes.append(np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1)
            flat.append(np.delete(ids, marks))
        for e in self.tokenizer.encode_batch_fast([w.decode() for w in alone], add_special_tokens=False):
            sizes.append(np.array([len(e.ids)]))
            flat.append(np.array(e.ids, np.int32))
        size = np.concatenate(sizes).astype(np.int32)
        base, known = len(self.ids), len(self.size)
        self.slot.update(zip(together + alone, range(known, known + len(size))))
        self.first = np.concatenate([self.first, base + np.cumsum(size, dtype=np.int32) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, *flat])

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of each text's ids)."""
        if not self.by_word:
            found = self._encode_whole(block, range(len(block)))
            return np.concatenate([np.empty(0, np.int64), *found]), np.cumsum([0, *map(len, found)])
        ids, offsets = self._encode_words(block)
        marked = self._spell_special(block)
        if not marked:
            return ids, offsets
        parts = [ids[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
        for i, whole in zip(marked, self._encode_whole(block, marked)):
            parts[i] = whole
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])

    def _encode_whole(self, block: Block, which) -> list[np.ndarray]:
        texts = [bytes(block.data[block.offsets[i] : block.offsets[i + 1]]).decode() for i in which]
        return [np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _spell_special(self, block: Block) -> list[int]:
        """Texts that hold the string of a special token."""
        data, out = block.data.tobytes(), set()
        for token in self.special:
            at = data.find(token)
            while at >= 0:
                i = int(np.searchsorted(block.offsets, at, side="right")) - 1
                if at + len(token) <= block.offsets[i + 1]:
                    out.add(i)
                at = data.find(token, at + 1)
        return sorted(out)

    def _encode_words(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        # The tokenizer lower-cases, so A-Z need not be kept apart here.
        data, bounds, first = units(Block(block.first, LOWER[block.data], block.offsets))
        if len(bounds) == 1:
            return np.empty(0, np.int64), np.zeros(len(block) + 1, np.int64)
        coded = binary_array(data, bounds).dictionary_encode()
        if len(self.slot) > CACHE_WORDS:
            self._forget()
        distinct = coded.dictionary.to_pylist()
        new = [word for word in distinct if word not in self.slot]
        if new:
            self._learn(new)
        slot = np.fromiter(map(self.slot.__getitem__, distinct), np.int32, len(distinct))
        index = slot[coded.indices.to_numpy(zero_copy_only=False)]
        length = self.size[index]
        ends = np.cumsum(length, dtype=np.int64)
        small = np.int32 if ends[-1] < 1 << 31 else np.int64  # half the memory for all but giant texts
        at = np.repeat((self.first[index] - (ends - length)).astype(small), length)
        at += np.arange(len(at), dtype=small)
        return self.ids[at], np.concatenate([[0], ends])[first]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


hold(__name__, encoder.cache_clear)


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, *, end_id: int = 1, key: str = "doc_id", text: str = "text") -> None:
    """Encode every text, append ``end_id``, and write the store.

    The texts are dealt by key ranges before they are encoded: a text is smaller than its ids, and the
    files then need no sort of their own.
    """

    def run(batches):
        before, part = 0, TaskContext.get().partitionId()  # tasks stand in the order of the key ranges
        for batch in batches:
            enc = encoder(tokenizer_path)
            first = 0
            for block in blocks(batch.column("text"), TEXT_BYTES):
                ids, offsets = enc.encode(block)
                n = len(block)
                ends = offsets[1:] + np.arange(1, n + 1)  # each text has one id more
                out = np.full(int(ends[-1]), end_id, dtype=np.int32)
                keep = np.ones(len(out), dtype=bool)
                keep[ends - 1] = False
                out[keep] = ids
                count = np.diff(ends, prepend=0)
                yield {
                    key: batch.column("key").slice(first, n),
                    "n_tokens": count,
                    "part": np.full(n, part),
                    "start_in_part": before + ends - count,
                    "ids": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(out)),
                }
                before += int(ends[-1])
                first += n

    tie = F.xxhash64("text")
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    rows = rows.repartitionByRange("key", tie).sortWithinPartitions("key", tie)
    out = per_partition(rows, run, f"{key} {docs.schema[key].dataType.simpleString()}, n_tokens bigint, part bigint, start_in_part bigint, ids array<int>")
    (
        out.write.option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .option("parquet.writer.version", "v2")  # delta encoding for integers without a dictionary
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#ids.list.element", "true")
        .option("compression", "zstd")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, *, low: int | None = None, high: int | None = None, key: str = "doc_id") -> DataFrame:
    """key, n_tokens, start (ids of all documents before it in the store) and ids.

    ``low`` and ``high`` bound the keys; the bounds reach the Parquet reader.  ``start`` needs a sum for each
    part, which reads two narrow columns alone.
    """
    stored = spark.read.parquet(path)
    by_part = stored.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    # One row a part: their number is bounded by the number of write tasks.
    before = by_part.withColumn("before", F.sum("part_tokens").over(Window.orderBy("part")) - F.col("part_tokens")).select("part", "before")
    wanted = stored
    if low is not None:
        wanted = wanted.filter(F.col(key) >= low)
    if high is not None:
        wanted = wanted.filter(F.col(key) <= high)
    return wanted.join(broadcast_if_small(before), "part").select(key, (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def checksums(tokens: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens and the CRC-32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            offsets = np.asarray(ids.offsets)
            data = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<u4").view(np.uint8))
            yield {
                key: batch.column("key"),
                "start": batch.column("start"),
                "n_tokens": np.diff(offsets),
                "ids_crc32": [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())],
            }

    rows = tokens.select(tokens[key].alias("key"), "start", "ids")
    # Another owner than the encoder's, so that workers that only read give up their words.
    return per_partition(
        rows, run, f"{key} {tokens.schema[key].dataType.simpleString()}, start bigint, n_tokens bigint, ids_crc32 bigint", f"{__name__}.checksums"
    )
