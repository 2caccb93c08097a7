"""Quality classifier by importance resampling.

Two bag-of-n-grams models over the same hashed bins, one of the target (documents labelled good and not
toxic) and one of the raw corpus, give every document an importance weight: the sum over its n-grams of
the log ratio of their probabilities.  Documents are then drawn without replacement in proportion to
their weights by the Gumbel top-k trick: add Gumbel noise to the log weight and take the k largest.

Three choices make the ratio usable as a classifier.  A bin's ratio is shrunk towards 1, and is exactly
1 where the counts cannot tell target from raw.  The ratio of a typical word is set to 1, or long
documents would gather weight for being long.  And documents are drawn by the weight of a passage of ``REFERENCE`` of
their words: the weight of a whole text grows with its length, so that among whole texts a long clean one with a few odd
words falls below a short one of abuse, and noise of a spread near 1 decides nothing.

k is the caller's; where none is given it is the number of documents whose weight passes a threshold, so clean documents
stay however many there are.  The ratios are counted on one half of the labelled documents (by a hash of their keys) and
the threshold is taken from the other.

Defined results for odd input: null and empty texts have no words and weight 0; texts of any length are weighed whole; a
null key gets its noise from its weight; repeated rows get equal weights and equal noise; ties at the
k-th place are all kept; without labels, or with one kind of label only, every document is kept; an
empty table gives an empty table; other columns are kept by :func:`drawn`, also such as are named like helper columns, and
ignored by :func:`resample`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fallline.llm import gram_counts
from fallline.llm.rows import per_batch
from fallline.llm.textblock import blocks
from fallline.runtime import broadcast_if_small, cut, fresh

#: Pseudo-count that shrinks a bin's ratio towards 1.
PRIOR = 1.0
#: A bin counts when target and raw differ by this many standard deviations and by this log ratio, and the
#: larger of count and expectation is at least LEAST.
SIGMAS, EFFECT, LEAST = 3.0, 0.7, 3.0
#: Two-word grams share their words with one-word grams, so they count in part.
PAIR_SHARE = 0.5
#: Documents are drawn by the weight of a passage of REFERENCE words; DAMPING words are added to a text's own length, so
#: that very short ones are not marked by a single word.
REFERENCE, DAMPING = 200.0, 20.0
SEED = 7


@dataclass
class Ratios:
    """Log ratio of target to raw for each bin."""

    word: np.ndarray
    pair: np.ndarray


def _log_ratio(everything: np.ndarray, target: np.ndarray) -> np.ndarray:
    n_all, n_target = everything.sum(), target.sum()
    if not n_all or not n_target:
        return np.zeros(len(everything))
    expected = everything * (n_target / n_all)
    ratio = np.log((target + PRIOR) / (expected + PRIOR))
    order = np.argsort(ratio)  # the median over running words is the ratio of a typical word
    mass = np.cumsum(everything[order])
    middle = ratio[order[np.searchsorted(mass, mass[-1] / 2)]]
    expected = expected * np.exp(middle)
    ratio = np.log((target + PRIOR) / (expected + PRIOR))
    tells = (np.maximum(expected, target) >= LEAST) & (np.abs(target - expected) >= SIGMAS * np.sqrt(np.maximum(expected, 1)))
    return np.where(tells & (np.abs(ratio) >= EFFECT), ratio, 0.0)


def halves(labels: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(labels for the ratios, labels for the threshold): all labels of a document are in one half."""
    side = F.pmod(F.xxhash64(F.lit("half"), labels[key]), F.lit(2))
    return labels.filter(side == 0), labels.filter(side == 1)


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text") -> Ratios:
    """Count n-grams of all documents and of the target among them."""
    c = gram_counts.count(docs, gram_counts.good_keys(labels, key=key), key=key, text=text)
    return Ratios(_log_ratio(c.word_all, c.word_target), _log_ratio(c.pair_all, c.pair_target))


def weigh(docs: DataFrame, ratios: Ratios, *, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, n_words, log_weight and passage_weight (of REFERENCE words) of every row (and the columns in ``keep``)."""
    names = ("key", "text", "n_words", "log_weight", "passage_weight")
    key_name, text_name, n_name, w_name, p_name = fresh(docs.select(*keep), *names) if keep else names
    shared = docs.sparkSession.sparkContext.broadcast((ratios.word.astype(np.float32), ratios.pair.astype(np.float32)))

    def run(batch: pa.RecordBatch) -> dict:
        word, pair = shared.value
        counts, weights, passages = [], [], []
        for block in blocks(batch.column(text_name)):
            doc, single, place, double = gram_counts.binned(block)
            n = np.bincount(doc, minlength=len(block))
            total = np.bincount(doc, word[single], len(block)) + PAIR_SHARE * np.bincount(doc[place], pair[double], len(block))
            counts.append(n)
            weights.append(total)
            passages.append(total * REFERENCE / (n + DAMPING))
        return {
            key_name: batch.column(key_name), **{c: batch.column(c) for c in keep},
            n_name: np.concatenate(counts), w_name: np.concatenate(weights), p_name: np.concatenate(passages),
        }

    rows = docs.select(docs[key].alias(key_name), docs[text].alias(text_name), *[docs[c] for c in keep])
    schema = T.StructType([
        T.StructField(key_name, docs.schema[key].dataType), *[docs.schema[c] for c in keep],
        T.StructField(n_name, T.LongType()), T.StructField(w_name, T.DoubleType()), T.StructField(p_name, T.DoubleType()),
    ])
    return per_batch(rows, run, schema)


def threshold(weighed: DataFrame, labels: DataFrame, *, key: str = "doc_id") -> float:
    """The passage weight that best parts good from bad labelled documents.

    Labelled weights are counted in a fixed number of bins, so what reaches the driver is bounded.
    """
    fine = gram_counts.good_keys(labels, key=key).withColumnRenamed("key", "good_key")
    known = labels.filter(labels[key].isNotNull()).select(labels[key].alias("label_key")).distinct()
    known = known.join(fine, F.col("label_key") == F.col("good_key"), "left").select("label_key", F.col("good_key").isNotNull().alias("good"))
    edges = F.floor(F.greatest(F.least(F.col("passage_weight"), F.lit(500.0)), F.lit(-500.0)) * 8).cast("int")
    got = weighed.select("key", "passage_weight").join(broadcast_if_small(known), F.col("key") == F.col("label_key"))
    got = got.groupBy(edges.alias("bin")).agg(F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad")).toPandas().sort_values("bin")
    if not len(got) or not got["good"].sum() or not got["bad"].sum():
        return -np.inf
    # Rejecting bins 0 to i gains their bad and loses their good documents; a good one weighs as its share allows.
    gain = (got["bad"].cumsum() / got["bad"].sum() - 4 * got["good"].cumsum() / got["good"].sum()).to_numpy()
    best = int(np.argmax(gain))
    return -np.inf if gain[best] <= 0 else (int(got["bin"].iloc[best]) + 1) / 8


def gumbel_key(weight: Column, key: Column, instead: Column) -> Column:
    """Log weight plus Gumbel noise that depends on the seed and the key alone (``instead`` for a null key)."""
    h = F.xxhash64(F.lit(SEED), F.coalesce(key.cast("string"), instead.cast("string")))
    uniform = (F.shiftrightunsigned(h, 12).cast("double") + 0.5) / F.lit(float(1 << 52))
    return weight - F.log(-F.log(uniform))


def kth_largest(values: DataFrame, column: str, k: int) -> float:
    """The k-th largest value, exactly, by four rounds of counting 16 bits; no sort and no single task.

    Doubles are mapped to integers in the same order.
    """
    if k <= 0:
        return np.inf
    bits = values.select(F.expr(f"CAST({column} AS DOUBLE)").alias("v")).mapInArrow(_ordered_bits, "o bigint")
    prefix = 0
    for shift in (48, 32, 16, 0):
        digit = F.shiftrightunsigned("o", shift).bitwiseAND(0xFFFF)
        got = bits.filter(F.shiftrightunsigned("o", shift + 16) == prefix) if shift < 48 else bits
        counts = sorted(((r[0], r[1]) for r in got.groupBy(digit.alias("d")).count().collect()), reverse=True)
        for d, n in counts:
            if k <= n:
                prefix = prefix << 16 | d
                break
            k -= n
        else:
            return -np.inf
    out = np.array([prefix], dtype=np.uint64)
    sign = np.uint64(1 << 63)
    return float(np.where(out & sign, out ^ sign, ~out).view(np.float64)[0])


def _ordered_bits(batches):
    sign = np.uint64(1 << 63)
    for batch in batches:
        v = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint64)
        o = np.where(v & sign, ~v, v | sign)
        yield pa.RecordBatch.from_arrays([pa.array(o.view(np.int64))], ["o"])


def _noisy(key: str, n_words: str, weight: str) -> Column:
    return gumbel_key(F.col(weight), F.col(key).cast("string"), F.xxhash64(weight, n_words))


def _draw(docs: DataFrame, ratios: Ratios, labels: DataFrame, key: str, text: str, k: int | None) -> tuple[DataFrame, float]:
    """(key, n_words, weights and sample_key of every row; the sample key of the last row drawn)."""
    weighed = weigh(docs, ratios, key=key, text=text)
    scores = cut(weighed.withColumn("sample_key", _noisy("key", "n_words", "passage_weight")), "weights")
    if k is None:
        limit = threshold(scores, labels, key=key)
        k = scores.filter(F.col("passage_weight") >= F.lit(float(limit))).count()
    return scores, float(kth_largest(scores, "sample_key", k))


def resample(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", k: int | None = None) -> DataFrame:
    """key, n_words, log_weight, passage_weight, sample_key and kept of every row of ``docs``."""
    ratio_labels, other_labels = halves(labels, key)
    scores, last = _draw(docs, fit(docs, ratio_labels, key=key, text=text), other_labels, key, text, k)
    return scores.withColumn("kept", F.col("sample_key") >= F.lit(last)).withColumnRenamed("key", key)


def drawn(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", k: int | None = None) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns.

    Only a number a row is kept between the passes; the texts are read and weighed again rather than
    written to disk in between.
    """
    columns = docs.columns
    ratio_labels, other_labels = halves(labels, key)
    ratios = fit(docs, ratio_labels, key=key, text=text)
    _, last = _draw(docs, ratios, other_labels, key, text, k)
    key_name, _, n_name, _, p_name = fresh(docs, "key", "text", "n_words", "log_weight", "passage_weight")
    whole = weigh(docs, ratios, key=key, text=text, keep=tuple(columns))
    return whole.filter(_noisy(key_name, n_name, p_name) >= F.lit(last)).select(*columns)
