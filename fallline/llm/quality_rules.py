"""Quality rules: document statistics, two fixed rules, and boosted trees over the statistics.

Words are maximal runs without ASCII white space (0x20, 0x09 to 0x0D), compared byte for byte.

Defined results for odd input: a null text has no words and fails the rules; so does an empty one;
repeated rows get equal results; texts of any length are counted whole; labels that are null, or whose document is missing,
are left out; a document of several labels is good if all call it good; of several texts under one labelled key the one of the
smallest features is fitted on; where the labels hold one class only, or too few documents to fit, the trees have nothing to say and the verdict is the
rules' alone; an empty table gives an empty table; other columns of ``docs`` are ignored or, also under the names of
the result's columns, kept as the call says.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fallline.llm import boosting
from fallline.llm.rows import per_batch
from fallline.llm.textblock import IS_SPACE, Block, binary_array, blocks, gram_hashes, mix, ranges, words
from fallline.runtime import fresh

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: Labelled documents that the trees are fitted on, at most; those with the smallest hashes are taken.
TRAIN_ROWS = 8_000
#: A document is kept when the trees give it this probability of good quality.
KEEP_PROBABILITY = 0.5

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, dtype=bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_SHOUT = np.zeros(256, dtype=bool)
_SHOUT[[ord(c) for c in "!?"]] = True

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "mean_word", "symbols", "dup_lines", "repeated", "upper", "digits", "shouts", "distinct", "words_per_line")
#: More symbols, repeated lines, repeated windows, capitals or exclamation marks never raise the score.
MONOTONE = {FEATURES.index(f): -1 for f in ("symbols", "dup_lines", "repeated", "upper", "shouts")}


def _per_text(block: Block, mask: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return np.diff(total[block.offsets])


def _repeated(code: np.ndarray, doc: np.ndarray, size: int) -> np.ndarray:
    """Which windows of ``size`` words stand twice or more in their text.  Hashes find candidates; the words
    decide."""
    n = len(code) - size + 1
    out = np.zeros(max(n, 0), dtype=bool)
    if n <= 0:
        return out
    inside = np.flatnonzero(doc[:n] == doc[size - 1 :])
    with np.errstate(over="ignore"):
        key = mix(gram_hashes(mix(code.astype(np.uint64) + np.uint64(1)), size)[inside] ^ mix(doc[inside].astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    key, at = key[order], inside[order]
    same = key[1:] == key[:-1]
    near = np.flatnonzero(same)
    equal = doc[at[near]] == doc[at[near + 1]]
    for k in range(size):
        equal &= code[at[near] + k] == code[at[near + 1] + k]
    if equal.all():
        out[at[near]] = out[at[near + 1]] = True
        return out
    # Different windows share a hash: settle them by their words.
    rows = np.stack([doc[inside], *(code[inside + k] for k in range(size))], axis=1)
    _, back, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    out[inside] = count[back.ravel()] > 1
    return out


def block_statistics(block: Block) -> dict[str, np.ndarray]:
    """The statistics of each text of a block, as columns."""
    data, n = block.data, len(block)
    w = words(block)
    n_words = np.diff(w.first)
    lead = (data & 0xC0) != 0x80
    size = w.end - w.start
    out = {
        "n_words": n_words,
        "word_chars": _per_text(block, lead & ~IS_SPACE[data]),
        "n_symbols": _per_text(block, _SYMBOL[data]),
    }
    code = np.empty(0, np.int64)
    distinct = np.zeros(n, np.int64)
    if len(w.start):
        coded = binary_array(data[ranges(w.start, size)], np.concatenate([[0], np.cumsum(size)])).dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        seen = np.unique(w.doc * (len(coded.dictionary) + 1) + code)
        distinct = np.bincount(seen // (len(coded.dictionary) + 1), minlength=n)
    # Lines: cut at line feeds and at the ends of texts; a line's bytes exclude its line feed.
    feed = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([feed + 1, block.offsets[:-1]]))
    starts = starts[starts < max(len(data), 1)] if len(data) else starts[:0]
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    ends = ends - (data[np.maximum(ends - 1, 0)] == 10) * (ends > starts) if len(starts) else ends
    solid = np.concatenate([[0], np.cumsum(~IS_SPACE[data], dtype=np.int64)])
    kept = solid[ends] > solid[starts] if len(starts) else np.zeros(0, bool)
    starts, ends = starts[kept], ends[kept]
    line_doc = np.searchsorted(block.offsets, starts, side="right") - 1
    n_lines = np.bincount(line_doc, minlength=n)[:n]
    dup = np.zeros(n, np.int64)
    if len(starts):
        length = ends - starts
        lines = binary_array(data[ranges(starts, length)], np.concatenate([[0], np.cumsum(length)])).dictionary_encode()
        key = np.unique(line_doc * (len(lines.dictionary) + 1) + lines.indices.to_numpy(zero_copy_only=False))
        dup = n_lines - np.bincount(key // (len(lines.dictionary) + 1), minlength=n)[:n]
    out["n_dup_lines"] = dup
    cover = np.zeros(len(code) + 1, np.int64)
    hit = np.flatnonzero(_repeated(code, w.doc, WINDOW))
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0, dtype=np.int64)])
    out["n_repeat_words"] = np.diff(covered[w.first])
    many = np.maximum(n_words, 1)
    letters = np.maximum(_per_text(block, _UPPER[data] | _LOWER[data]), 1)
    out["x"] = np.stack([
        np.log1p(n_words), out["word_chars"] / many, out["n_symbols"] / many, dup / np.maximum(n_lines, 1), out["n_repeat_words"] / many,
        _per_text(block, _UPPER[data]) / letters, _per_text(block, _DIGIT[data]) / many, _per_text(block, _SHOUT[data]) / many,
        distinct / many, n_words / np.maximum(n_lines, 1),
    ], axis=1).astype(np.float64)
    return out


def _columns(column: pa.Array) -> dict[str, np.ndarray]:
    parts = [block_statistics(b) for b in blocks(column)]
    return {k: np.concatenate([p[k] for p in parts]) for k in (*BASE, "x")}


def statistics(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the base statistics, and the features as an array of doubles."""

    def run(batch: pa.RecordBatch) -> dict:
        got = _columns(batch.column("text"))
        x = got.pop("x")
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
        return {"key": batch.column("key"), **got, "features": flat}

    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    out = per_batch(rows, run, f"key {docs.schema[key].dataType.simpleString()}, " + ", ".join(f"{c} bigint" for c in BASE) + ", features array<double>")
    return out.withColumnRenamed("key", key)


def train(docs: DataFrame, labels: DataFrame, *, rows: int = TRAIN_ROWS, key: str = "doc_id", text: str = "text", label: str = "quality") -> boosting.Forest:
    """Fit the trees on at most ``rows`` labelled documents, the ones with the smallest hashes of their keys."""
    known = labels.filter(labels[key].isNotNull() & labels[label].isNotNull()).groupBy(labels[key].alias("key")).agg(F.min(label).cast("double").alias("label"))
    known = known.orderBy(F.xxhash64("key"), "key").limit(rows)  # the parameter bounds what is broadcast and collected
    picked = docs.select(docs[key].alias("key"), docs[text].alias("text")).join(F.broadcast(known), "key")
    # Repeated keys could exceed the bound: one row a document.
    sample = statistics(picked, key="key", text="text").groupBy("key").agg(F.min("features").alias("features")).join(F.broadcast(known), "key").toPandas()
    if not len(sample):
        return boosting.constant(1.0)
    sample = sample.sort_values("key")
    model = boosting.fit(np.array(sample["features"].tolist()), sample["label"].to_numpy(), monotone=MONOTONE)
    return model if len(model.roots) else boosting.constant(1.0)  # too few rows, or one class


def judge(docs: DataFrame, model: boosting.Forest, *, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the base statistics, score, base_failed and kept; ``keep`` names columns of ``docs`` that stay."""
    names = ("key", "text", *BASE, "score", "base_failed", "kept")
    key_name, text_name, *outs = fresh(docs.select(*keep), *names) if keep else names

    def run(batch: pa.RecordBatch) -> dict:
        got = _columns(batch.column(text_name))
        score = model.probability(got["x"])
        failed = (got["n_words"] < MIN_WORDS) | (100 * got["n_repeat_words"] > MAX_REPEAT_PERCENT * got["n_words"])
        new = dict(zip(outs, [*(got[c] for c in BASE), score, failed, ~failed & (score >= KEEP_PROBABILITY)]))
        return {key_name: batch.column(key_name), **{c: batch.column(c) for c in keep}, **new}

    rows = docs.select(docs[key].alias(key_name), docs[text].alias(text_name), *[docs[c] for c in keep])
    kinds = [*["bigint"] * len(BASE), "double", "boolean", "boolean"]
    schema = T.StructType([
        T.StructField(key_name, docs.schema[key].dataType), *[docs.schema[c] for c in keep],
        *[T.StructField(c, T._parse_datatype_string(k)) for c, k in zip(outs, kinds)],
    ])
    out = per_batch(rows, run, schema)
    return out if keep else out.withColumnRenamed(key_name, key)


def rejected_go(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules and the trees keep, with all their columns."""
    columns = docs.columns
    kept_name = fresh(docs, "key", "text", *BASE, "score", "base_failed", "kept")[-1]
    return judge(docs, train(docs, labels, key=key, text=text), key=key, text=text, keep=tuple(columns)).filter(F.col(kept_name)).select(*columns)
