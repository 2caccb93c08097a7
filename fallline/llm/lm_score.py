"""Language-model scoring by cross-entropy difference.

A target model (documents labelled good and not toxic) and a background model (the whole corpus) are
interpolated two-word models over the same vocabulary, every word and pair of words of the corpus, with the same weights.
Each word of a document costs minus the log of its probability under either model; a document's score is the mean
difference of these losses, target minus background, so lower means closer to the target.

No model has seen the document that it scores: the document's own counts are left out, of the background and, for a
target document, of the target.  A text that occurs elsewhere too is therefore scored apart from one that does not.

Defined results for odd input: null and empty texts have no tokens and null scores; texts of any length are counted and
scored whole; repeated rows score alike, each with the others' counts; without target documents the target model is the
background model and every difference is 0; a model that is empty without the document deals all probability evenly; an
empty table gives an empty table; other columns are ignored, also such as are named like the result's.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fallline.llm import gram_counts

#: Weights of the two-word, one-word and uniform distributions.
PAIR_WEIGHT, WORD_WEIGHT, UNIFORM_WEIGHT = 0.5, 0.4, 0.1
#: Words among which the uniform share is dealt out, at least; a corpus of more distinct words deals it among those.
VOCABULARY = 1 << 18


@dataclass(frozen=True)
class Model:
    """p(w | v) = PAIR_WEIGHT c(v w) / c(v) + WORD_WEIGHT c(w) / N + UNIFORM_WEIGHT / V; a first word, or one after an
    unseen word, gives the two-word share to the one-word distribution.

    Where v ended a text the end of the text is what follows it, so p sums to 1 over the vocabulary and the end.
    The counts c stay distributed: a model knows the corpus they come from, N and V, and which counts are its own.
    """

    docs: DataFrame  #: the corpus as it was given
    rows: DataFrame  #: key, text and hit of the corpus
    target: bool  #: whether target documents alone count
    total: int
    size: int

    def losses(self) -> Losses:
        return Losses(int(self.target), self.total, self.size)


@dataclass(frozen=True)
class Losses:
    """The part of a model that workers need."""

    which: int
    total: int
    size: int

    def loss(self, place: np.ndarray, word: np.ndarray, pair: np.ndarray, total: np.ndarray) -> np.ndarray:
        """-log p of each word, by the counts of words and pairs; ``place`` are the words that a next word of the same text
        follows, ``total`` is N for each word."""
        one = np.where(total > 0, word / np.maximum(total, 1), 1 / self.size)
        uniform = UNIFORM_WEIGHT / self.size
        p = (PAIR_WEIGHT + WORD_WEIGHT) * one + uniform
        history = word[place]
        seen = history > 0
        at = place[seen] + 1
        p[at] = PAIR_WEIGHT * (pair[seen] / history[seen]) + WORD_WEIGHT * one[at] + uniform
        return -np.log(p)


def models(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text") -> tuple[Model, Model]:
    """(target, background), counted over all documents."""
    rows = gram_counts.marked(docs, gram_counts.good_keys(labels, key=key), key=key, text=text)
    distinct, n_all, n_target = gram_counts.sizes(rows)
    size = max(VOCABULARY, distinct)
    background = Model(docs, rows, False, n_all, size)
    return (Model(docs, rows, True, n_target, size) if n_target else background), background


def score(docs: DataFrame, target: Model, background: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, target_loss, background_loss (means a token) and loss_difference."""
    if docs is background.docs:
        rows = background.rows.withColumns({"counted": F.lit(True), "scored": F.lit(True)})
    else:
        corpus = background.rows.select(F.lit(None).cast(docs.schema[key].dataType).alias("key"), "text", "hit", F.lit(True).alias("counted"), F.lit(False).alias("scored"))
        rows = docs.select(docs[key].alias("key"), docs[text].alias("text"), F.lit(False).alias("hit"), F.lit(False).alias("counted"), F.lit(True).alias("scored")).unionByName(corpus)
    both = target.losses(), background.losses()

    def run(table: pa.Table, given: list) -> dict:
        counts, sums = [], ([], [])
        hit, counted = (table.column(c).to_numpy() for c in ("hit", "counted"))
        seen_by = counted, counted & hit  # background, target
        for block, doc, place, word, pair in given:
            n = np.bincount(doc, minlength=len(block))
            counts.append(n)
            for out, model in zip(sums, both):
                mine = seen_by[model.which][block.first : block.first + len(block)].astype(np.int64)
                left = mine[doc]
                loss = model.loss(place, word[model.which] - left * word[2], pair[model.which] - left[place] * pair[2], (model.total - mine * n)[doc])
                out.append(np.bincount(doc, loss, len(block)))
        n = np.concatenate(counts)
        empty = n == 0
        t, b = (np.concatenate(x) / np.maximum(n, 1) for x in sums)
        return {
            "key": table.column("key"), "n_tokens": n, "target_loss": pa.array(t, mask=empty),
            "background_loss": pa.array(b, mask=empty), "loss_difference": pa.array(t - b, mask=empty),
        }

    out = gram_counts.lookup(rows, run, f"key {docs.schema[key].dataType.simpleString()}, n_tokens bigint, target_loss double, background_loss double, loss_difference double")
    return out.withColumnRenamed("key", key)
