"""Counts of word n-grams over a whole corpus, for the language models and the classifier.

Words are lower-cased (A-Z) runs without ASCII white space; a word and a pair of words that follow each other
are told apart by their 64-bit hashes.

:func:`lookup` counts every n-gram exactly, in a table that grows with the corpus and that no machine holds
whole.  Documents are dealt into chunks of a bounded size.  A chunk sorts its distinct n-grams and sends each
range of hashes (a bucket) as one packed row with their counts; a bucket adds the counts of all chunks and
answers each with the sums, in the order in which it asked.

:func:`count`, for the classifier, counts in bins instead: a word falls into one of 2^WORD_BITS and a pair into
one of 2^PAIR_BITS.  A partition counts into two arrays and sends its non-zero bins; the sums over all
partitions have at most one row a bin, whatever the corpus, so they fit the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from fallline.llm.rows import bound_batches, per_batch, per_partition, schema_fields, trim
from fallline.llm.textblock import LOWER, Block, blocks, gram_hashes, slice_hashes, words
from fallline.runtime import broadcast_if_small, ship

WORD_BITS = 18
PAIR_BITS = 20
#: Bytes of text in a chunk, about; buckets of n-grams, as a power of 2 that is larger where a bucket would exceed so many bytes of text.
CHUNK_BYTES = 8 << 20
BUCKET_BITS, BUCKET_BYTES = 10, 32 << 20


def grams(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text of each word, hash of each word, places with a next word in the same text, hash of that pair)."""
    data = LOWER[block.data]
    w = words(Block(block.first, data, block.offsets))
    if not len(w.start):
        nothing = np.empty(0, np.int64)
        return nothing, nothing.astype(np.uint64), nothing, nothing.astype(np.uint64)
    single = slice_hashes(data, w.start, w.end)
    place = np.flatnonzero(w.doc[:-1] == w.doc[1:])
    return w.doc, single, place, gram_hashes(single, 2)[place]


def binned(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same with the bins of words and pairs."""
    doc, single, place, pair = grams(block)
    return doc, (single >> np.uint64(64 - WORD_BITS)).astype(np.int64), place, (pair >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


@dataclass
class Counts:
    """How often each bin occurs in the background (all documents) and in the target."""

    word_all: np.ndarray
    word_target: np.ndarray
    pair_all: np.ndarray
    pair_target: np.ndarray


def marked(docs: DataFrame, target_keys: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text and hit of every row: whether its key is in ``target_keys`` (one column)."""
    wanted = target_keys.toDF("target_key").filter("target_key IS NOT NULL").distinct().withColumn("hit", F.lit(1))
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return rows.join(broadcast_if_small(wanted), F.col("key") == F.col("target_key"), "left").select("key", "text", F.col("hit").isNotNull().alias("hit"))


def sizes(rows: DataFrame) -> tuple[int, int, int]:
    """(distinct words, running words, running words of the target) of rows with text and hit."""

    def run(batch: pa.RecordBatch) -> dict:
        hit = batch.column("hit").to_numpy(zero_copy_only=False)
        parts = [(single, hit[block.first + doc]) for block in blocks(batch.column("text")) for doc, single, _, _ in [grams(block)]]
        word, code = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        mine = np.bincount(code, np.concatenate([p[1] for p in parts]), len(word))
        return {"word": word.view(np.int64), "n_all": np.bincount(code, minlength=len(word)), "n_target": mine.astype(np.int64)}

    found = per_batch(rows.select("text", "hit"), run, "word bigint, n_all bigint, n_target bigint")
    sums = found.groupBy("word").agg(F.sum("n_all").alias("n_all"), F.sum("n_target").alias("n_target"))
    return tuple(int(x or 0) for x in sums.agg(F.count("*"), F.sum("n_all"), F.sum("n_target")).first())


def _distinct(column: pa.ChunkedArray) -> tuple[list, list[int], np.ndarray, np.ndarray]:
    """(blocks with their n-grams, lengths of the n-gram arrays, distinct n-grams in order, number of each running one among them)."""
    found = [(block, *grams(block)) for block in blocks(column)]
    arrays = [a for _, _, single, _, pair in found for a in (single, pair)]
    gram, code = np.unique(np.concatenate(arrays), return_inverse=True)
    return found, [len(a) for a in arrays], gram, code


def _pack_hashes(x: np.ndarray, low: int) -> bytes:
    """Ascending hashes from ``low`` on: their gaps, each in as many bytes as the widest needs."""
    gaps = np.diff(x, prepend=np.uint64(low))
    width = max(-(-int(gaps.max()).bit_length() // 8), 1)
    return gaps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack_hashes(buffer: pa.Buffer, n: int, low: int) -> np.ndarray:
    gaps = np.zeros((n, 8), np.uint8)
    gaps[:, : buffer.size // n] = np.frombuffer(buffer, np.uint8).reshape(n, -1)
    return np.cumsum(gaps.view(np.uint64).ravel(), dtype=np.uint64) + np.uint64(low)


def _pack_counts(x: np.ndarray) -> bytes:
    """A byte a count; those of 255 or more follow in full."""
    return np.minimum(x, 255).astype(np.uint8).tobytes() + x[x >= 255].astype(np.int64).tobytes()


def _unpack_counts(column: pa.ChunkedArray, n: list[int]) -> np.ndarray:
    out = [np.empty(0, np.int64)]
    for value, k in zip(column, n):
        buffer = value.as_buffer()
        counts = np.frombuffer(buffer, np.uint8, k).astype(np.int64)
        counts[counts == 255] = np.frombuffer(buffer.slice(k).to_pybytes(), np.int64)
        out.append(counts)
    return np.concatenate(out)


def _own(doc: np.ndarray, code: np.ndarray) -> np.ndarray:
    """How often each running n-gram stands in its own text."""
    if not len(code):
        return np.empty(0, np.int64)
    _, back, n = np.unique(doc.astype(np.int64) * (int(code.max()) + 1) + code, return_inverse=True, return_counts=True)
    return n[back]


def lookup(rows: DataFrame, function: Callable, schema: str) -> DataFrame:
    """Give documents the counts of their n-grams in the whole corpus.

    ``rows`` has key, text, hit (in the target), counted (in the corpus) and scored.  ``function`` gets a chunk's
    table, and per block of its texts (block, text of each word, places, word counts, pair counts), the counts as
    triples of arrays (corpus, target, the text's own); it returns columns by name.
    """
    spark = rows.sparkSession
    ship(spark)
    bound_batches(spark)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(BUCKET_BITS, int(size // BUCKET_BYTES).bit_length())
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("key", "text"), F.lit(int(size // CHUNK_BYTES) + 1)))

    def ask(table: pa.Table) -> pa.Table:
        pa.set_memory_pool(pa.system_memory_pool())
        found, _, gram, code = _distinct(table.column("text"))
        hit, counted = (table.column(c).to_numpy() for c in ("hit", "counted"))
        sums = []
        for of_row in (counted, counted & hit):
            mine = [of_row[block.first + d] for block, doc, _, place, _ in found for d in (doc, doc[place])]
            sums.append(np.bincount(code, np.concatenate(mine), len(gram)).astype(np.int32))
        edge = np.concatenate([np.searchsorted(gram, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), [len(gram)]])
        bucket = np.flatnonzero(np.diff(edge))
        edge = np.append(edge[bucket], len(gram))
        spans = list(zip(edge[:-1], edge[1:]))
        columns = [[_pack_hashes(gram[a:b], int(k) << 64 - bits) for k, (a, b) in zip(bucket, spans)], *([_pack_counts(x[a:b]) for a, b in spans] for x in sums)]
        chunk = np.full(len(bucket), table.column("chunk")[0].as_py())
        trim()
        return pa.table([pa.array(chunk, pa.int64()), pa.array(bucket, pa.int32()), pa.array(np.diff(edge), pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names=["chunk", "bucket", "n", "gram", "n_all", "n_target"])

    def answer(table: pa.Table) -> pa.Table:
        pa.set_memory_pool(pa.system_memory_pool())
        n = table.column("n").to_pylist()
        low = table.column("bucket")[0].as_py() << 64 - bits
        gram, code = np.unique(np.concatenate([_unpack_hashes(x.as_buffer(), k, low) for x, k in zip(table.column("gram"), n)]), return_inverse=True)
        ends = np.cumsum(n)[:-1]
        out = [table.column("chunk"), table.column("bucket"), table.column("n")]
        for name in ("n_all", "n_target"):
            sums = np.bincount(code, _unpack_counts(table.column(name), n), len(gram)).astype(np.int64)[code]
            out.append(pa.array([_pack_counts(x) for x in np.split(sums, ends)], pa.binary()))
        trim()
        return pa.table(out, names=["chunk", "bucket", "n", "n_all", "n_target"])

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        pa.set_memory_pool(pa.system_memory_pool())
        if not table.num_rows:
            return arrow.empty_table()
        found, lengths, gram, code = _distinct(table.column("text"))
        answers = answers.sort_by("bucket")
        both = [_unpack_counts(answers.column(name), answers.column("n").to_pylist()) for name in ("n_all", "n_target")]
        parts = np.split(code, np.cumsum(lengths)[:-1])
        given = []
        for i, (block, doc, _, place, _) in enumerate(found):
            word, pair = parts[2 * i], parts[2 * i + 1]
            given.append((block, doc, place, (*(n[word] for n in both), _own(doc, word)), (*(n[pair] for n in both), _own(doc[place], pair))))
        columns = function(table, given)
        out = pa.table([columns[f.name].cast(f.type) if isinstance(columns[f.name], (pa.Array, pa.ChunkedArray)) else pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)
        trim()
        return out.filter(table.column("scored"))

    arrow = to_arrow_schema(schema_fields(schema))
    asked = rows.groupBy("chunk").applyInArrow(ask, "chunk bigint, bucket int, n int, gram binary, n_all binary, n_target binary")
    answers = asked.groupBy("bucket").applyInArrow(answer, "chunk bigint, bucket int, n int, n_all binary, n_target binary")
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, schema)


def count(docs: DataFrame, target_keys: DataFrame, *, key: str = "doc_id", text: str = "text") -> Counts:
    """Count all documents; those whose key is in ``target_keys`` (one column) also count as target."""
    rows = marked(docs, target_keys, key=key, text=text).select("text", "hit")

    def run(batches):
        sizes = 1 << WORD_BITS, 1 << PAIR_BITS
        totals = [np.zeros((2, n), np.int64) for n in sizes]
        for batch in batches:
            hit = batch.column("hit").to_numpy(zero_copy_only=False)
            for block in blocks(batch.column("text")):
                doc, single, place, pair = binned(block)
                in_target = hit[block.first + doc]
                for total, bins, mine in ((totals[0], single, in_target), (totals[1], pair, in_target[place])):
                    total[0] += np.bincount(bins, minlength=total.shape[1])
                    total[1] += np.bincount(bins[mine], minlength=total.shape[1])
        for first, total in ((0, totals[0]), (sizes[0], totals[1])):
            at = np.flatnonzero(total[0])
            yield {"bin": pa.array((at + first).astype(np.int32)), "n_all": total[0][at], "n_target": total[1][at]}

    sums = per_partition(rows, run, "bin int, n_all bigint, n_target bigint").groupBy("bin").agg(F.sum("n_all").alias("n_all"), F.sum("n_target").alias("n_target"))
    table = sums.toArrow()
    out = np.zeros((2, (1 << WORD_BITS) + (1 << PAIR_BITS)))
    at = table.column("bin").to_numpy()
    out[0, at], out[1, at] = table.column("n_all").to_numpy(), table.column("n_target").to_numpy()
    edge = 1 << WORD_BITS
    return Counts(out[0, :edge], out[1, :edge], out[0, edge:], out[1, edge:])


def good_keys(labels: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Keys of documents that every label calls good and not toxic."""
    fine = F.min(F.coalesce(F.col("quality").cast("int"), F.lit(0))) + F.min(1 - F.coalesce(F.col("toxic").cast("int"), F.lit(0)))
    return labels.filter(labels[key].isNotNull()).groupBy(labels[key].alias("key")).agg(fine.alias("fine")).filter("fine = 2").select("key")
