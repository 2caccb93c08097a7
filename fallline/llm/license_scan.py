"""License scan by diagonal voting, in DataFrame operations alone.

Every run of K words of every text is hashed and joined to the positions of the same run in the notices.
A match votes for its diagonal, the offset between the text's and the notice's position; neighbouring
diagonals, which small insertions and deletions cause, are merged into bands.  In a band every diagonal opens a window,
from where the notice would begin on it, of twice the notice's length; a window becomes a span if the band's matched
runs inside it, compared word for word, cover enough of the notice.  Of windows that overlap the one that covers most,
and of these the first, is the span.  Beside the method, the base phrases are located exactly.

The notices are a fixed list, so their side of the join is broadcast; no text leaves its scan, and only
matches are shuffled.

Words are what stands between ASCII characters that are no letters or digits, with A-Z lower-cased.
Defined results for odd input: null and empty texts have no words, no labels and score 0; texts of any length are scanned
whole; repeated rows get equal results; rows with one key and different texts are kept apart by a hash of their text; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fallline.llm.license_texts import BASE_PHRASES, NOTICES

K = 3
#: Diagonals this near belong together.
NEIGHBOURS = 3
#: A notice of up to SHORT words must be covered whole, a longer one by this share.
SHORT, COVERAGE = 10, 0.75

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def text_words(text: Column) -> Column:
    """The words of a text, as an array."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _notice_runs(spark: SparkSession) -> DataFrame:
    rows = []
    for number, (text, label) in enumerate(NOTICES):
        words = _words_of(text)
        need = len(words) if len(words) <= SHORT else int(-(-COVERAGE * len(words) // 1))
        rows += [(number, label, len(words), need, i, *words[i : i + K]) for i in range(len(words) - K + 1)]
    runs = spark.createDataFrame(rows, f"notice int, label string, n_notice int, need int, at_notice int, {', '.join(f'v{k} string' for k in range(K))}")
    return F.broadcast(runs.withColumn("run", F.xxhash64(*[f"v{k}" for k in range(K)])))  # a fixed list


def spans(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text_hash, notice, label, first_word, last_word, covered and score of every verified span."""
    spark = docs.sparkSession
    rows = docs.select(docs[key].alias("key"), F.xxhash64(F.coalesce(docs[text].cast("string"), F.lit(""))).alias("text_hash"), text_words(docs[text]).alias("w"))
    rows = rows.filter(F.size("w") >= K)
    shifted = F.arrays_zip(*[F.slice("w", k + 1, F.size("w") - (K - 1)).alias(f"w{k}") for k in range(K)])
    runs = rows.select("key", "text_hash", F.posexplode(shifted).alias("at", "r"))
    runs = runs.select("key", "text_hash", "at", *[F.col("r")[f"w{k}"].alias(f"w{k}") for k in range(K)])
    runs = runs.withColumn("run", F.xxhash64(*[f"w{k}" for k in range(K)]))
    same = F.lit(True)
    for k in range(K):
        same = same & (F.col(f"w{k}") == F.col(f"v{k}"))
    hits = runs.join(_notice_runs(spark), "run").filter(same)
    # Repeated rows vote once.
    hits = hits.select("key", "text_hash", "notice", "label", "n_notice", "need", "at", "at_notice", (F.col("at") - F.col("at_notice")).alias("diagonal")).distinct()
    votes = hits.groupBy("key", "text_hash", "notice", "label", "n_notice", "need", "diagonal").agg(
        F.collect_set("at_notice").alias("places"))
    along = Window.partitionBy("key", "text_hash", "notice").orderBy("diagonal")
    begins = (F.col("diagonal") - F.lag("diagonal").over(along) > NEIGHBOURS).cast("int")
    votes = votes.withColumn("begins", F.coalesce(begins, F.lit(1))).withColumn("band", F.sum("begins").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    of_band = ["key", "text_hash", "notice", "band"]
    longest = max(len(_words_of(t)) for t, _ in NOTICES)
    near = Window.partitionBy(*of_band).orderBy("diagonal").rangeBetween(-longest, 2 * longest)
    windows = votes.withColumn("near", F.collect_list(F.struct("diagonal", "places")).over(near))
    # (place in the text, place in the notice) of the band's runs that lie whole in the window.
    inside = F.flatten(F.transform("near", lambda v: F.transform(v["places"], lambda p: F.struct((v["diagonal"] + p).alias("at"), p.alias("place")))))
    inside = F.filter(inside, lambda h: (h["at"] >= F.col("diagonal")) & (h["at"] + K <= F.col("diagonal") + 2 * F.col("n_notice")))
    windows = windows.withColumn("inside", inside).drop("near", "places")
    covered = F.size(F.array_distinct(F.flatten(F.transform("inside", lambda h: F.sequence(h["place"], h["place"] + (K - 1))))))
    windows = windows.withColumn("covered", covered).filter("covered >= need")
    windows = windows.select(*of_band, "label", "n_notice", "covered", F.array_min(F.transform("inside", lambda h: h["at"])).alias("first_word"),
                             (F.array_max(F.transform("inside", lambda h: h["at"])) + (K - 1)).alias("last_word"))
    order = Window.partitionBy(*of_band).orderBy("first_word", "last_word")
    reached = F.max("last_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    windows = windows.withColumn("opens", F.coalesce((F.col("first_word") > reached).cast("int"), F.lit(1)))
    windows = windows.withColumn("place", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    best = windows.groupBy(*of_band, "label", "n_notice", "place").agg(F.max_by(F.struct("first_word", "last_word", "covered"), F.struct("covered", -F.col("first_word"), -F.col("last_word"))).alias("b"))
    return best.select("key", "text_hash", "notice", "label", "b.first_word", "b.last_word", "b.covered", (F.col("b.covered") / F.col("n_notice")).alias("score"))


def _begins(words: str, parts: list[str]):
    """Whether a phrase's parts stand in the array column ``words`` from place i (counted from 1) on."""

    def test(i: Column) -> Column:
        out = F.element_at(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            out = out & (F.get(F.col(words), i - 1 + k) == part)
        return F.coalesce(out, F.lit(False))

    return test


def _places(words: str) -> tuple[Column, Column]:
    """(starts of all base phrases, their labels in the order of the phrases) in the array column ``words``."""
    starts, labels = [], []
    for phrase, label in BASE_PHRASES:
        found = F.filter(F.sequence(F.lit(1), F.size(words)), _begins(words, phrase.split(" ")))
        starts.append(F.transform(found, lambda i: i - 1))
        labels.append(F.when(F.size(found) > 0, label))
    return F.concat(*starts), F.array_compact(F.array(*labels))


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels and score of every row."""
    low = F.translate(F.coalesce(docs[text].cast("string"), F.lit("")), _UPPER, _LOWER)
    rows = docs.select(docs[key].alias("key"), F.xxhash64(F.coalesce(docs[text].cast("string"), F.lit(""))).alias("text_hash"), low.alias("low"))
    rows = rows.withColumn("w", text_words(F.col("low")))
    # Without these strings no phrase can stand in the text.
    possible = (F.contains("low", F.lit("license")) | (F.contains("low", F.lit("cc")) & F.contains("low", F.lit("by")))) & (F.size("w") > 0)
    starts, labels = _places("w")
    base = rows.select(
        "key", "text_hash", F.size("w").cast("long").alias("n_words"),
        F.when(possible, F.struct(starts.alias("starts"), labels.alias("labels"))).alias("base"),
    ).select(
        "key", "text_hash", "n_words",
        F.coalesce(F.size("base.starts"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min("base.starts").cast("long").alias("first_word"), F.array_max("base.starts").cast("long").alias("last_word"),
        F.coalesce("base.labels", F.array().cast("array<string>")).alias("base_labels"),
    )
    base = base.withColumn("n_base", F.greatest("n_base", F.lit(0)))
    found = spans(docs, key=key, text=text).groupBy(F.col("key").alias("k"), F.col("text_hash").alias("h")).agg(F.collect_set("label").alias("more"), F.max("score").alias("covered"))
    out = base.join(found, F.col("key").eqNullSafe(F.col("k")) & (F.col("text_hash") == F.col("h")), "left")
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return out.select(
        F.col("key").alias(key), "n_words", "n_base", "first_word", "last_word", joined(F.col("base_labels")).alias("base_labels"),
        joined(F.concat("base_labels", F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("covered", F.lit(0.0))).alias("score"),
    )
