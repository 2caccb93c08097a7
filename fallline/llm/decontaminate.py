"""Benchmark decontamination: BM25 retrieval with block-max WAND, then a check of the words themselves.

Test items are cut into segments of at most ``SEGMENT`` words and indexed.  Every training text is cut
into passages so that any run of a segment's length lies whole in one of them, and every passage is a
query.  A segment is retrieved when its BM25 score reaches ``RECALL`` of the score that it gives itself.

Block-max WAND over many queries at once: segments lie in blocks of near thresholds, and blocks in
superblocks.  The largest impact of each term in a superblock, summed along the text and differenced at
passage ends, bounds every passage's score against it; passages below the lowest threshold there stop.
The rest meet the blocks' bounds, and what passes them is scored in full against the block's postings.
Bounds never lie below scores, so everything above the threshold is found.

A retrieved item counts as a leak when its question and its answer (its last sentences, as few as
have GRAM words; the whole item where nothing is left before them) both have ``OVERLAP`` of their word n-grams in the text.

The index is built and broadcast in shards of a bounded number of words, with the word statistics of the whole
benchmark, so that scores and results do not depend on the number of shards.  The driver holds one shard at a time.  One
pass over the texts meets ``PASS_SHARDS`` shards; more take more passes, so a worker's memory is bounded too.

Words are lower-cased runs of ASCII letters, digits and other non-ASCII bytes.  Defined results for odd
input: null and empty texts and items match nothing; texts and items of any length are searched and indexed whole; equal items are found each under its own id;
repeated rows give repeated leaks; an empty table on either side gives no leaks; other columns are kept
by :func:`without_leaks` and ignored by :func:`leaks`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fallline.llm.rows import per_batch, per_partition
from fallline.llm.textblock import LOWER, Block, blocks, distinct_sorted, gram_hashes, ranges, slice_hashes, words
from fallline.runtime import cut, fresh

SEGMENT, STRIDE = 40, 32
PASSAGE = SEGMENT + STRIDE
RECALL = 0.6
OVERLAP = 0.5
GRAM = 5
BLOCK, SUPERBLOCK = 8, 64
K1, B = 1.2, 0.75
#: Words of test items in one broadcast index, about, and such indexes in one pass over the texts.
SHARD_WORDS, PASS_SHARDS = 20_000, 64

#: Everything in ASCII but letters and digits parts words.
PARTS = np.zeros(256, dtype=bool)
PARTS[:128] = [not chr(c).isalnum() for c in range(128)]


def _hashed(block: Block):
    data = LOWER[block.data]
    w = words(Block(block.first, data, block.offsets), PARTS)
    return w, slice_hashes(data, w.start, w.end)


def _parts(text: str) -> tuple[str, str]:
    """(question, answer): the last sentence is the answer, or the last ones until they have GRAM words."""
    end = len(text.rstrip(" \t\r\n.!?"))
    while (cut := max(text.rfind(c, 0, end) for c in ".!?\n")) >= 0:
        question, answer = text[: cut + 1], text[cut + 1 :]
        if not any(c.isalnum() for c in question):
            break
        if len(_hashed(next(blocks(pa.array([answer]))))[1]) >= GRAM:
            return question, answer
        end = cut
    return text, text


def _grams(text: str) -> np.ndarray:
    """Hashes of the n-grams of a part, and their length: shorter for a shorter part."""
    block = next(blocks(pa.array([text])))
    _, h = _hashed(block)
    return np.unique(gram_hashes(h, min(GRAM, max(len(h), 1)))), min(GRAM, len(h))


@dataclass
class Index:
    """One shard of the inverted index."""

    term: np.ndarray  #: sorted hashes of words
    block_first: np.ndarray  #: terms x (blocks + 1): where a term's postings in each block begin
    segment: np.ndarray
    impact: np.ndarray
    block_max: np.ndarray  #: terms x blocks
    super_max: np.ndarray  #: terms x superblocks
    least: np.ndarray  #: score that retrieves a segment
    block_least: np.ndarray  #: the smallest of a block, less a rounding allowance
    item: np.ndarray  #: number of each segment's item
    ids: list
    parts: list  #: per item ((question grams, n), (answer grams, n))


def _segments(items: list[tuple[object, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment of each word, word hashes, item of each segment)."""
    of, hashes, item, n = [], [], [], 0
    for i, (_, text) in enumerate(items):
        for block in blocks(pa.array([text])):
            _, h = _hashed(block)
            for piece in np.array_split(h, -(-len(h) // SEGMENT)) if len(h) else ():  # of near lengths, so none has a low threshold
                of.append(np.full(len(piece), n))
                hashes.append(piece)
                item.append(i)
                n += 1
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(of), np.concatenate(hashes), np.array(item)


def build(items: list[tuple[object, str]], frequency: dict[int, int] | None = None, segments: int | None = None) -> Index | None:
    """Index ``items``; ``frequency`` (segments that hold a word's hash) and ``segments`` are those of all shards."""
    of, hashes, item = _segments(items)
    n = len(item)
    if not n:
        return None
    term, code = np.unique(hashes, return_inverse=True)
    pair, tf = np.unique(code * n + of, return_counts=True)
    t, seg = pair // n, pair % n
    df = np.bincount(t, minlength=len(term))
    if frequency is not None:
        df = np.array([frequency[int(h)] for h in term.view(np.int64)])
    total = segments or n
    idf = np.log1p((total - df + 0.5) / (df + 0.5))
    length = np.bincount(of, minlength=n)
    impact = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[seg] / SEGMENT))
    least = RECALL * np.bincount(seg, impact, n)
    rank = np.argsort(np.argsort(least, kind="stable"), kind="stable")  # near thresholds share a block
    seg = rank[seg]
    order = np.lexsort((seg, t))
    t, seg, impact = t[order], seg[order], impact[order]
    back = np.argsort(rank)
    maxima = []
    for width in (BLOCK, SUPERBLOCK):
        table = np.zeros((len(term), -(-n // width)), np.float32)
        np.maximum.at(table, (t, seg // width), np.nextafter(impact.astype(np.float32), np.float32(np.inf)))
        maxima.append(table)
    least, n_blocks = least[back], -(-n // BLOCK)
    starts = np.searchsorted(t * n_blocks + seg // BLOCK, np.arange(len(term) * n_blocks + 1))
    block_first = np.concatenate([starts[:-1].reshape(len(term), n_blocks), starts[n_blocks::n_blocks, None]], axis=1)
    return Index(term, block_first, seg, impact, *maxima, least, np.minimum.reduceat(least, np.arange(0, n, BLOCK)) - 1e-6, item[back],
                 [i for i, _ in items], [tuple(map(_grams, _parts(text))) for _, text in items])


def _score(index: Index, terms: np.ndarray, b: int, doc: int, hits: dict) -> None:
    """Score one passage in full against the segments of block ``b`` and keep what is retrieved."""
    a = index.block_first[terms, b]
    posting = ranges(a, index.block_first[terms, b + 1] - a)
    least = index.least[b * BLOCK : (b + 1) * BLOCK]
    score = np.bincount(index.segment[posting] - b * BLOCK, index.impact[posting], len(least))
    for k in np.flatnonzero(score >= least - 1e-9):
        pair = doc, int(index.item[b * BLOCK + k])
        hits[pair] = max(hits.get(pair, 0.0), float(score[k] / least[k] * RECALL))


def find(block: Block, index: Index, hashed=None) -> list[tuple[int, int, float, float, float]]:
    """(text, item number, best share of a segment's own score, question overlap, answer overlap) of leaks."""
    w, h = hashed or _hashed(block)
    if not len(h):
        return []
    at = np.searchsorted(index.term, h)
    at[at == len(index.term)] = 0
    known = index.term[at] == h
    code = at[known]
    before = np.concatenate([[0], np.cumsum(known)])
    n_passages = -(-np.diff(w.first) // STRIDE)
    doc = np.repeat(np.arange(len(block)), n_passages)
    begin = ranges(np.zeros(len(block), np.int64), n_passages) * STRIDE + w.first[doc]
    end = before[np.minimum(begin + PASSAGE, w.first[doc + 1])]
    begin = before[begin]  # a passage's known words are code[begin:end]
    hits: dict[tuple[int, int], float] = {}
    for s in range(index.super_max.shape[1]):
        bound = np.zeros(len(code) + 1)
        np.cumsum(index.super_max[code, s], dtype=np.float64, out=bound[1:])
        low = index.block_least[s * SUPERBLOCK // BLOCK : (s + 1) * SUPERBLOCK // BLOCK]
        alive = np.flatnonzero(bound[end] - bound[begin] >= low.min())
        for some in np.array_split(alive, -(-len(alive) // 4096)) if len(alive) else ():
            size = end[some] - begin[some]
            # Each passage's distinct known words, passage after passage.
            pair = distinct_sorted(np.repeat(np.arange(len(some)), size) * len(index.term) + code[ranges(begin[some], size)])
            passage, term = pair // len(index.term), pair % len(index.term)
            first = np.searchsorted(passage, np.arange(len(some) + 1))
            limits = np.add.reduceat(index.block_max[:, s * SUPERBLOCK // BLOCK : (s + 1) * SUPERBLOCK // BLOCK][term], first[:-1], axis=0, dtype=np.float64)
            for i, b in zip(*np.nonzero(limits >= low)):
                _score(index, term[first[i] : first[i + 1]], b + s * SUPERBLOCK // BLOCK, int(doc[some[i]]), hits)
    out = []
    for (d, item), score in sorted(hits.items()):
        mine = h[w.first[d] : w.first[d + 1]]
        share = [float(np.isin(grams, gram_hashes(mine, size)).mean()) if len(grams) else 0.0 for grams, size in index.parts[item]]
        if min(share) >= OVERLAP:
            out.append((d, item, min(score, 1.0), *share))
    return out


def _statistics(items: DataFrame) -> DataFrame:
    """Rows (h, n): segments that hold a word; one row without h: n segments of n_words words in all.  ``items`` has text."""

    def run(batches):
        segments = n_words = 0
        for batch in batches:
            of, hashes, _ = _segments([(None, t) for t in batch.column("text").to_pylist()])
            n_words += len(hashes)
            if len(hashes):
                segments += int(of[-1]) + 1
                word, code = np.unique(hashes, return_inverse=True)
                pairs = np.unique(code * (int(of[-1]) + 1) + of)
                yield {"h": word.view(np.int64), "n": np.bincount(pairs // (int(of[-1]) + 1), minlength=len(word)), "n_words": np.zeros(len(word), np.int64)}
        yield {"h": pa.nulls(1, pa.int64()), "n": [segments], "n_words": [n_words]}

    return per_partition(items.select("text"), run, "h bigint, n bigint, n_words bigint").groupBy("h").agg(F.sum("n").alias("n"), F.sum("n_words").alias("n_words"))


def shards(benchmark: DataFrame, *, key: str = "item_id", text: str = "text") -> Iterator[Index]:
    """The index of a benchmark, one shard after the other."""
    items = benchmark.select(benchmark[key].alias("item"), benchmark[text].cast("string").alias("text")).filter("text IS NOT NULL")
    known = cut(_statistics(items), "statistics")
    total = known.filter("h IS NULL").first()
    if total is None or not total["n"]:
        return
    n = -(-total["n_words"] // SHARD_WORDS)
    shard = items.withColumn("shard", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
    for k in range(n):  # each turn gathers one shard, whose size is bounded
        mine = shard.filter(F.col("shard") == k)
        words_of = _statistics(mine).filter("h IS NOT NULL").select("h") if n > 1 else known.filter("h IS NOT NULL").select("h")
        table = words_of.join(known.select("h", "n"), "h").toArrow()
        frequency = dict(zip(table.column("h").to_pylist(), table.column("n").to_pylist()))
        rows = [(r["item"], r["text"]) for r in mine.sort("item", "text").toLocalIterator()]
        if (index := build(rows, frequency, int(total["n"]))) is not None:
            yield index


def _passes(benchmark: DataFrame, item_key: str) -> list[list]:
    """Broadcast shards, as many together as one pass over the texts meets."""
    shared = [benchmark.sparkSession.sparkContext.broadcast(index) for index in shards(benchmark, key=item_key)]
    return [shared[i : i + PASS_SHARDS] for i in range(0, len(shared), PASS_SHARDS)]


def leaks(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id") -> DataFrame:
    """key, item key, score, question_overlap and answer_overlap of every leak."""
    spark = docs.sparkSession
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    names = [*fresh(spark.range(0).toDF(key), item_key)]
    schema = f"key {docs.schema[key].dataType.simpleString()}, item {benchmark.schema[item_key].dataType.simpleString()}, score double, question_overlap double, answer_overlap double"
    out = spark.createDataFrame([], schema)
    for some in _passes(benchmark, item_key):

        def run(batch: pa.RecordBatch, some=some) -> dict:
            found = []
            for block in blocks(batch.column("text")):
                hashed = _hashed(block)
                for shared in some:
                    found += [(block.first + d, shared.value.ids[i], *rest) for d, i, *rest in find(block, shared.value, hashed)]
            where, item, *rest = zip(*found) if found else [()] * 5
            return {"key": batch.column("key").take(pa.array(where, pa.int64())), "item": list(item), **dict(zip(("score", "question_overlap", "answer_overlap"), map(list, rest)))}

        out = out.unionByName(per_batch(rows, run, schema))
    return out.withColumnsRenamed({"key": key, "item": names[0]})


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_key: str = "item_id") -> DataFrame:
    """The rows of ``docs`` that hold no test item, with all their columns."""
    columns = docs.columns
    flag = fresh(docs, "leaks")[0]
    out = docs
    for some in _passes(benchmark, item_key):

        def run(batch: pa.RecordBatch, some=some) -> dict:
            leaky = np.zeros(batch.num_rows, dtype=bool)
            for block in blocks(batch.column(text)):
                hashed = _hashed(block)
                for shared in some:
                    for d, *_ in find(block, shared.value, hashed):
                        leaky[block.first + d] = True
            return {**{c: batch.column(c) for c in columns}, flag: leaky}

        schema = T.StructType([*[docs.schema[c] for c in columns], T.StructField(flag, T.BooleanType())])
        out = per_batch(out.select(*columns), run, schema).filter(~F.col(flag)).select(*columns)
    return out
