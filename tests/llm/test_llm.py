"""Each operator against a brute-force form, and on odd input: nulls, empty and long texts, ties, repeated rows, empty
tables and extra columns with clashing names."""

import collections
import hashlib
import html
import itertools
import json
import os
import random
import re
import time
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fallline.llm import (
    boosting, byte_bpe, decontaminate, gram_counts, html_tree, importance, jaccard_join, license_scan, lm_score, quality_rules, queries, token_store, trees, warc, wrapper,
)
from fallline.llm.textblock import blocks

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
LOWER = {c: c + 32 for c in range(65, 91)}
ODD = [None, "", " \t\n", "a", "a b", "A  bé\x0bc", "x" * 3000, "long words " * 3000, "same text here once", "same text here once"]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, texts, extra=False):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    out = spark.createDataFrame(rows, DOCS)
    if extra:
        out = out.withColumns({"key": F.lit("k"), "kept": F.lit(1), "score": F.lit(None).cast("double"), "node": F.array(F.lit(1)), "n_words": F.lit("w")})
    return out


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def prose(rnd, n, words="the of and a stone river lies under high long hills where water turns south again".split()):
    return " ".join(rnd.choice(words) + ("." if rnd.random() < 0.1 else "") for _ in range(n))


# op5


def test_pieces_and_ids_equal_tiktoken():
    vocab = byte_bpe.vocabulary(RANKS)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})
    rnd = random.Random(1)
    alphabet = list("ab'srelvtmd ''' \n\t  1é.,!ßdon't　漢😀²Ⅷ\x85 \x1c")
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(3000)] + ODD + ["é" * 3000, "ab" * 2000]
    for block in blocks(pa.array(texts), 20_000):
        ids, offsets = vocab.encode(block)
        assert np.array_equal(vocab.decode(ids)[0], block.data)
        for i in range(len(block)):
            assert enc.encode_ordinary(texts[block.first + i] or "") == ids[offsets[i] : offsets[i + 1]].tolist()


def test_bpe_digests_and_decoding(spark):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})
    df = docs(spark, ODD, extra=True)
    for r in byte_bpe.digests(df, RANKS).collect():
        ids = enc.encode_ordinary(ODD[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((ODD[r.doc_id] or "").encode()).hexdigest()
    back = byte_bpe.decode(byte_bpe.encode(df, RANKS, verify=True), RANKS).collect()
    assert all(bytes(r.decoded).decode() == (ODD[r.doc_id] or "") for r in back)
    assert byte_bpe.digests(df.limit(0), RANKS).count() == 0


# op2


def test_token_store(spark, tmp_path):
    tok = Tokenizer.from_file(WORDS)
    texts = ODD + ["end <|endoftext|> x", "<|startoftext|>", "a<|endoftext|>\u0338b <|ENDOFTEXT|> <|endoftext|", "|>", "wörd, " * 250_000, "It's 'RE <|endoftext|> \x01 é, İstanbul ΑΣ,x a.b\"'s", "don't,-re 12ab"]
    path = str(tmp_path / "t")
    token_store.write_tokens(docs(spark, texts, extra=True), WORDS, path)
    rows = sorted(token_store.checksums(token_store.read_tokens(spark, path)).collect())
    start = 0
    for r, t in zip(rows, texts, strict=True):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    whole = rows
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 1)
    try:
        token_store.write_tokens(docs(spark, texts), WORDS, path + "-files")
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert sorted(token_store.checksums(token_store.read_tokens(spark, path + "-files")).collect()) == whole
    part = token_store.read_tokens(spark, path, low=3, high=4).collect()
    assert {r.doc_id: list(r.ids) for r in part}.keys() == {3, 4}
    token_store.write_tokens(docs(spark, []), WORDS, path + "0")
    assert token_store.checksums(token_store.read_tokens(spark, path + "0")).count() == 0
    twice = docs(spark, ["b", "a"]).withColumn("doc_id", F.lit(None).cast("bigint"))
    token_store.write_tokens(twice, WORDS, path + "1")
    assert sorted(r.start for r in token_store.read_tokens(spark, path + "1").collect()) == [0, 2]


def test_parts_stand_in_the_order_of_their_numbers(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(k, 2, k, 0, [k, 1]) for k in (9, 10, 99_999, 100_000, 1_000_000)]
    spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint, part bigint, start_in_part bigint, ids array<int>").write.parquet(path)
    assert [r.start for r in sorted(token_store.read_tokens(spark, path).collect())] == [0, 2, 4, 6, 8]


# op8


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "PIECE", 300)  # less than a record
    pages = [(1, "http://a/x", "<p>é</p>"), (2, "http://a/y\r\nX: forged", "<p>é</p>"), (3, None, None), (4, "http://b", ""), (5, "http://c", "z"), (5, "http://c", "z"), (None, "http://n", "q" * 3_000_000), (None, "", "q" * 3_000_000)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("payload", F.lit(1)).withColumn("key", F.lit("k"))
    path = str(tmp_path / "w")
    warc.write_archive(df, path)
    rows = warc.read_archive(spark, path).collect()
    largest = {}
    for k, _, h in pages:
        if k is not None or (h or "") not in largest:
            largest[h or ""] = max(k, largest.get(h or "") or 0) if k is not None else None
    for r in rows:
        body = (dict((k, h) for k, _, h in pages)[r.key] or "").encode()
        assert r.payload_bytes == len(body) and bytes(r.payload) == body
        assert r.payload_digest == __import__("base64").b32encode(hashlib.sha1(body).digest()).decode()
        assert r.record_type == ("response" if largest[body.decode()] == r.key else "revisit")
        assert r.refers_to == (None if r.record_type == "response" else largest[body.decode()])
        header, block, _ = next(warc.parse_warc(bytes(r.record)))
        assert b"forged" not in [line.split(b":")[-1].strip() for line in header.split(b"\r\n") if line.startswith(b"X")]
        assert block.endswith(body) if r.record_type == "response" else b"WARC-Refers-To" in header
    assert spark.read.parquet(path + "/payloads").count() == 4
    warc.export_warc(spark, path, path + "-files")
    again = warc.import_warc(spark, path + "-files/*.gz").collect()
    assert sorted(bytes(r.header) + bytes(r.block) + b"\r\n\r\n" for r in again) == sorted(bytes(r.record) for r in rows)
    field = lambda name: [r[0] for r in spark.createDataFrame([(r.header,) for r in rows], "h binary").select(warc.header_field(F.col("h"), name)).collect()]
    ids = field("WARC-Record-ID")
    assert len(set(ids)) == len(rows) and set(filter(None, field("WARC-Refers-To"))) <= set(ids)
    few = str(tmp_path / "f")
    warc.write_archive(df, few, min_bytes=5)
    assert {r.record_type for r in warc.read_archive(spark, few, with_payload=False).filter("key = 3 OR key = 4").collect()} == {"response"}
    warc.write_archive(df.limit(0), path + "0")
    assert warc.read_archive(spark, path + "0").count() == 0


def test_warc_finds_a_changed_payload(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archive(spark.createDataFrame([(1, "u", "x")], "page_id bigint, url string, html string"), path)
    bad = spark.read.parquet(path + "/payloads").withColumn("payload", F.lit(b"y"))
    bad.write.parquet(path + "2/payloads")
    spark.read.parquet(path + "/records").write.parquet(path + "2/records")
    with pytest.raises(Exception, match="differs"):
        warc.read_archive(spark, path + "2").collect()


# op4


def brute_statistics(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    count = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {j for i in range(len(w) - 4) if count[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(cover)


def test_quality_rules(spark):
    rnd = random.Random(2)
    good = [prose(rnd, 60) for _ in range(120)]
    bad = [" ".join(w + "%%%" for w in prose(rnd, 60).split()) for _ in range(120)]
    texts = good + bad + ODD + ["line one\nline two\nline one\n\nline one", "a b c d e a b c d e f"]
    df = docs(spark, texts, extra=True)
    known = labels(spark, [(i, 1, 0) for i in range(0, 120, 2)] + [(i, 0, 0) for i in range(120, 240, 2)] + [(None, 1, 0), (99999, 0, 1), (3, None, None)])
    model = quality_rules.train(df, known)
    rows = {r.doc_id: r for r in quality_rules.judge(df, model).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        e = brute_statistics(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == e
        assert r.base_failed == (e[0] < 10 or 100 * e[4] > 20 * e[0])
        assert not (r.base_failed and r.kept)
    held = [i for i in range(1, 240, 2) if not rows[i].base_failed]
    assert all(rows[i].kept == (i < 120) for i in held)
    assert quality_rules.judge(df.limit(0), model).count() == 0
    assert quality_rules.train(df, known.limit(0)).probability(np.zeros((2, 10))).min() > 0.5
    kept = quality_rules.rejected_go(df, known)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.kept}


def test_trees_keep_their_order():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(2000, 3))
    y = ((x[:, 0] + 0.5 * x[:, 1] ** 2 + rnd.normal(size=2000) * 0.5) > 0).astype(float)
    model = boosting.fit(x, y, monotone={0: 1})
    assert np.mean((model.probability(x) > 0.5) == (y > 0.5)) > 0.8
    for _ in range(20):
        grid = np.repeat(rnd.normal(size=(1, 3)), 50, axis=0)
        grid[:, 0] = np.linspace(-3, 3, 50)
        assert (np.diff(model.margin(grid)) >= -1e-12).all()


def test_hash_collisions_are_settled(monkeypatch):
    code, doc = np.array([1, 2, 3, 4, 5, 9, 1, 2, 3, 4, 5, 1, 2, 3, 4, 5]), np.array([0] * 11 + [1] * 5)
    expected = quality_rules._repeated(code, doc, 5).tolist()
    monkeypatch.setattr(quality_rules, "gram_hashes", lambda h, n: np.zeros(len(h) - n + 1, np.uint64))
    assert quality_rules._repeated(code, doc, 5).tolist() == expected == [True] + [False] * 5 + [True] + [False] * 5


# op9 and op10


def corpus(spark, seed=3):
    rnd = random.Random(seed)
    good = [prose(rnd, 80) for _ in range(300)]
    bad = [prose(rnd, 70) + " " + " ".join(rnd.choice(("idiot", "scum", "moron")) for _ in range(8)) for _ in range(100)]
    return good + bad, labels(spark, [(i, 1, 0) for i in range(0, 300, 2)] + [(i, 1, 1) for i in range(300, 400, 2)] + [(None, 1, 0)])


def test_importance_resampling(spark):
    texts, known = corpus(spark)
    df = docs(spark, texts + ODD, extra=True)
    rows = {r.doc_id: r for r in importance.resample(df, known).collect()}
    assert len(rows) == len(texts) + len(ODD)
    held = [rows[i].kept == (i < 300) for i in range(1, 400, 2)]
    assert np.mean(held) > 0.97
    assert rows[len(texts)].log_weight == 0 and rows[len(texts) + 1].n_words == 0
    drawn = importance.drawn(df, known)
    assert drawn.columns == df.columns and {r.doc_id for r in drawn.collect()} == {i for i, r in rows.items() if r.kept}
    assert importance.resample(df.limit(0), known).count() == 0
    assert importance.resample(df, known.limit(0)).filter("NOT kept").count() == 0
    assert importance.resample(docs(spark, ["a b"] * 3).withColumn("doc_id", F.lit(None).cast("bigint")), known).count() == 3


def test_weights_and_draw_equal_brute_force(spark):
    texts, known = corpus(spark)
    texts, df = texts + ODD, docs(spark, texts + ODD)
    ratio_labels, _ = importance.halves(known)
    target = {r[0] for r in gram_counts.good_keys(ratio_labels).collect()}
    assert 0 < len(target) < known.filter("toxic = 0 AND doc_id IS NOT NULL").count()

    def bins(t):
        _, single, place, double = gram_counts.binned(next(blocks(pa.array([t or ""]))))
        return single.tolist(), double.tolist()

    grams, log_ratio = [bins(t) for t in texts], []
    for kind in (0, 1):
        every, mine = collections.Counter(), collections.Counter()
        for i, g in enumerate(grams):
            every.update(g[kind])
            mine.update(g[kind] if i in target else ())
        share = sum(mine.values()) / sum(every.values())
        first = {x: np.log((mine[x] + importance.PRIOR) / (n * share + importance.PRIOR)) for x, n in every.items()}
        mass, middle = 0, None
        for x in sorted(first, key=lambda x: first[x]):
            mass += every[x]
            if middle is None and 2 * mass >= sum(every.values()):
                middle = first[x]
        out = {}
        for x, n in every.items():
            e = n * share * np.exp(middle)
            r = np.log((mine[x] + importance.PRIOR) / (e + importance.PRIOR))
            tells = max(e, mine[x]) >= importance.LEAST and abs(mine[x] - e) >= importance.SIGMAS * np.sqrt(max(e, 1))
            out[x] = r if tells and abs(r) >= importance.EFFECT else 0.0
        log_ratio.append(out)
    k = 250
    rows = {r.doc_id: r for r in importance.resample(df, known, k=k).collect()}
    for i, (single, double) in enumerate(grams):
        weight = sum(log_ratio[0][x] for x in single) + importance.PAIR_SHARE * sum(log_ratio[1][x] for x in double)
        assert rows[i].log_weight == pytest.approx(weight, abs=1e-3) and rows[i].n_words == len(single)
        assert rows[i].passage_weight == pytest.approx(rows[i].log_weight * importance.REFERENCE / (len(single) + importance.DAMPING), abs=1e-9)
    order = sorted((r.sample_key for r in rows.values()), reverse=True)
    assert {i for i, r in rows.items() if r.kept} == {i for i, r in rows.items() if r.sample_key >= order[k - 1]} and sum(r.kept for r in rows.values()) == k
    noise = np.array([r.sample_key - r.passage_weight for r in rows.values()])
    assert abs(noise.mean() - 0.5772) < 0.25 and abs(noise.std() - 1.2825) < 0.25  # Gumbel noise
    plain = {i for i, _ in sorted(rows.items(), key=lambda x: -x[1].passage_weight)[:k]}
    assert plain != {i for i, r in rows.items() if r.kept}  # it matters


def test_kth_largest(spark):
    rnd = random.Random(4)
    values = [rnd.choice((rnd.gauss(0, 50), 1.5, -0.0, float(rnd.randint(-3, 3)))) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 250, 499, 500):
        assert importance.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]
    assert importance.kth_largest(df, "v", 0) == np.inf and importance.kth_largest(df, "v", 501) == -np.inf


def brute_losses(words, counted, target):
    """Mean losses of each text under models of all texts (``counted``) and of ``target``, less the text itself."""
    out = []
    size = max(2**18, len({w for i in counted for w in words[i]}))
    for i, mine in enumerate(words):
        row = []
        for keys in (target, counted):
            others = [words[j] for j in keys if j != i]
            one, two = collections.Counter(itertools.chain(*others)), collections.Counter(p for w in others for p in zip(w, w[1:]))
            total, uniform, losses = sum(one.values()), 0.1 / size, []
            for k, w in enumerate(mine):
                p = one[w] / total if total else 1 / size
                if k and one[mine[k - 1]]:
                    losses.append(-np.log(0.5 * two[mine[k - 1], w] / one[mine[k - 1]] + 0.4 * p + uniform))
                else:
                    losses.append(-np.log(0.9 * p + uniform))
            row.append(np.mean(losses) if losses else None)
        out.append(row)
    return out


def test_language_model_difference(spark):
    texts, known = corpus(spark)
    texts = [t for i, t in enumerate(texts) if i % 5 == 0]  # 60 good, 20 bad
    twice, once = (" ".join(f"{x}{k}" for k in range(30)) for x in "uv")
    texts += [twice, twice, once, *ODD]
    df = docs(spark, texts, extra=True)
    known = labels(spark, [(i, 1, 0) for i in range(0, 60, 2)] + [(i, 1, 1) for i in range(60, 80, 2)] + [(None, 1, 0)])
    target, background = lm_score.models(df, known)
    rows = {r.doc_id: r for r in lm_score.score(df, target, background).collect()}
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) for t in texts]
    for i, (t, b) in enumerate(brute_losses(words, range(len(words)), range(0, 60, 2))):
        r = rows[i]
        assert r.n_tokens == len(words[i])
        if t is None:
            assert r.target_loss is None and r.background_loss is None and r.loss_difference is None
        else:
            assert (r.target_loss, r.background_loss, r.loss_difference) == pytest.approx((t, b, t - b), abs=1e-9)
    assert np.mean([rows[i].loss_difference for i in range(60, 80)]) > np.mean([rows[i].loss_difference for i in range(60)])
    # A text that occurs twice is known to the background by its other copy.
    assert rows[80].background_loss == rows[81].background_loss < rows[82].background_loss - 5
    assert lm_score.score(df.limit(0), target, background).count() == 0
    same = lm_score.models(df, known.limit(0))
    assert same[0] is same[1]


def test_language_models_count_exactly(spark, monkeypatch):
    # Two words, and two pairs of words, whose hashes share their first 18 or 20 bits.
    def alike(names, which, bits):
        seen = {}
        for name in names:
            code = int(gram_counts.grams(next(blocks(pa.array([name]))))[which][0]) >> (64 - bits)
            if seen.setdefault(code, name) != name:
                return seen[code], name
        raise AssertionError("none alike")

    often, rare = alike((f"w{i}" for i in range(20_000)), 1, 18)
    pair, other = alike((f"v u{i}" for i in range(50_000)), 3, 20)
    texts = [" ".join([often] * 300), rare, f"{pair} {pair} {pair}", other] + [f"own{i}" for i in range(60)]
    monkeypatch.setattr(gram_counts, "CHUNK_BYTES", 64)
    df = docs(spark, texts)
    target, background = lm_score.models(df, labels(spark, [(0, 1, 0)]))
    words = [t.split() for t in texts]
    rows = {r.doc_id: r for r in lm_score.score(df, target, background).collect()}
    for i, (t, b) in enumerate(brute_losses(words, range(len(words)), [0])):
        assert (rows[i].target_loss, rows[i].background_loss) == pytest.approx((t, b), abs=1e-9)
    # The same texts, not as the corpus that was counted: nothing of them is left out.
    elsewhere = {r.doc_id - 1000: r for r in lm_score.score(df.withColumn("doc_id", F.col("doc_id") + 1000), target, background).collect()}
    one, two = collections.Counter(itertools.chain(*words)), collections.Counter(p for w in words for p in zip(w, w[1:]))
    total, uniform = sum(one.values()), 0.1 / 2**18
    for i, w in enumerate(words):
        losses = [-np.log(0.9 * one[w[0]] / total + uniform)]
        losses += [-np.log(0.5 * two[a, b] / one[a] + 0.4 * one[b] / total + uniform) for a, b in zip(w, w[1:])]
        assert elsewhere[i].background_loss == pytest.approx(np.mean(losses), abs=1e-9)


def test_quality_rules_decide_where_trees_cannot_be_fitted(spark):
    rnd = random.Random(5)
    df = docs(spark, [prose(rnd, 60) for _ in range(30)])
    want = [(r.doc_id, not r.base_failed) for r in quality_rules.judge(df, boosting.constant(1.0)).collect()]
    assert any(kept for _, kept in want)
    for known in ([(i, 0, 0) for i in range(4)], [(i, 0, 0) for i in range(30)], [(i, int(i == 0), 0) for i in range(10)]):
        model = quality_rules.train(df, labels(spark, known))
        assert sorted((r.doc_id, r.kept) for r in quality_rules.judge(df, model).collect()) == sorted(want)


def test_short_answers_do_not_hide_a_copied_question(spark):
    question = "Which of the seven rivers that rise in the northern hills turns south at last and never meets the open sea again"
    for item in (f"{question}? One.", f"Read this first. {question}? The one."):
        copy = item.replace("One.", "Two.").replace("The one.", "None.")
        bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
        assert decontaminate.leaks(docs(spark, [copy, "Nothing of it here at all, only other words."]), bench).count() == 1


# op7


def brute_components(texts, size, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    home = list(range(len(texts)))

    def find(i):
        while home[i] != i:
            i = home[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((find(i), find(j)))
            home[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def near_copies(rnd, n):
    out = []
    for _ in range(n):
        words = prose(rnd, rnd.randint(3, 120), words=[f"w{k}" for k in range(300)]).split()
        for _ in range(rnd.randint(1, 12)):
            copy = list(words)
            for _ in range(rnd.randint(0, max(1, len(words) // 25))):
                copy[rnd.randrange(len(copy))] = f"x{rnd.randint(0, 50)}"
            out.append(" ".join(copy))
    shared = prose(rnd, 12, words=[f"p{k}" for k in range(50)])
    return out + [shared] + [prose(rnd, rnd.randint(1, 40), words=[f"q{k}" for k in range(900)]) + " " + shared for _ in range(40)]


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80), (2, 60)])
def test_join_equals_all_pairs(spark, size, percent, monkeypatch):
    rnd = random.Random(size)
    texts = near_copies(rnd, 30) + ODD
    expected = brute_components(texts, size, percent)
    df = docs(spark, texts, extra=True)
    for shingles in (jaccard_join.TASK_SHINGLES, 400):  # where tasks hold little, regions are split as tables
        monkeypatch.setattr(jaccard_join, "TASK_SHINGLES", shingles)
        monkeypatch.setattr(jaccard_join, "HOT_LEAST", 5 if shingles == 400 else 16)
        counters = tuple(spark.sparkContext.accumulator(0) for _ in range(2))
        got = {r.doc: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_classes(df, size=size, percent=percent, counters=counters).collect()}
        assert [got[i] for i in range(len(texts))] == expected
        assert counters[0].value > 0 and counters[1].value > 0
    one = jaccard_join.one_of_each(df, size=size, percent=percent)
    assert one.columns == df.columns
    assert sorted(r.doc_id for r in one.collect()) == sorted({c for _, c in expected} | {i for i, (n, _) in enumerate(expected) if not n})


def brute_links(sets, percent):
    for i, j in itertools.combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            yield i, j


@pytest.mark.parametrize("edits", [0.5, 2, 6])
def test_pivots_find_every_link(edits):
    """Regions of copies around one text, of chains, and of sets equally far from each other: what links connect is
    connected, and nothing else; only open members need their links."""
    rnd = np.random.default_rng(int(edits * 2))
    for percent in (60, 80, 90):
        base, sets = np.arange(60), []
        for k in range(90):
            one = base + 1000 * (k % 3 == 2)
            flip = rnd.random(60) < edits / 60
            sets.append(np.unique(np.where(flip, rnd.integers(5000, 9000, 60), one)).astype(np.uint64))
            if k % 5 == 0:
                base = np.where(rnd.random(60) < 0.05, rnd.integers(5000, 9000, 60), base)  # the middle wanders
        links = list(brute_links(sets, percent))
        for open_ in (None, rnd.random(90) < 0.4):
            wanted = [(i, j) for i, j in links if open_ is None or open_[i] or open_[j]]
            count = [0, 0]
            i, j = jaccard_join.pivot_links(jaccard_join.Sets(sets), percent, open_, count)
            assert set(map(tuple, map(sorted, zip(i.tolist(), j.tolist())))) <= set(links)
            home = lambda pairs: jaccard_join._forest(90, *np.array(pairs or [(0, 0)], dtype=np.int64).T)
            label = np.arange(90)
            member, head = home(list(zip(i.tolist(), j.tolist())))
            label[member] = head
            assert all(label[x] == label[y] for x, y in wanted) and count[0] > 0 and count[1] <= 90 * 90


def test_one_pivot_settles_a_group_of_copies():
    rnd = np.random.default_rng(1)
    sets = [np.unique(np.where(np.arange(200) == rnd.integers(200), 500 + k, np.arange(200))).astype(np.uint64) for k in range(3000)]
    sets.append(np.arange(200).astype(np.uint64))
    count = [0, 0]
    i, _ = jaccard_join.pivot_links(jaccard_join.Sets(sets), 90, None, count)
    assert len(np.unique(i)) == 3000 and count == [1, 3001]


def test_sets_that_share_a_node_are_told_apart(spark, monkeypatch):
    whole = jaccard_join.nodes_of
    monkeypatch.setattr(jaccard_join, "nodes_of", lambda s, b, salt=0: whole(s, b, salt) if salt else whole(s, b) & 1)
    df = docs(spark, ["a b c d e", "f g h i j", "k l m n o", "p q r s t", "u v w x y"])
    assert [r.component_id for r in sorted(jaccard_join.jaccard_classes(df, size=3, percent=90).collect())] == list(range(5))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_all_links_of_the_tables_come_from_regions(spark):
    counters = tuple(spark.sparkContext.accumulator(0) for _ in range(2))
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = df.select("doc_id", "text").collect()
    got = {r.doc: r.component_id for r in jaccard_join.jaccard_classes(df, size=3, percent=90, counters=counters).collect()}
    block = next(blocks(pa.array([r.text for r in rows]), 1 << 30))
    shingles, bounds = jaccard_join.shingle_sets(block, 3)
    links = list(brute_links([shingles[a:b] for a, b in zip(bounds[:-1], bounds[1:])], 90))
    assert links and all(got[rows[i].doc_id] == got[rows[j].doc_id] for i, j in links)  # recall 1
    assert counters[0].value > 0


def test_join_of_odd_rows(spark):
    none = docs(spark, ["a b c d", "a b c d", "e f g h"]).withColumn("doc_id", F.lit(None).cast("bigint"))
    assert [r.component_id for r in jaccard_join.jaccard_classes(none, size=3, percent=90).collect()] == [None] * 3
    assert jaccard_join.one_of_each(none).count() == 2
    again = docs(spark, ["a b c d e f"]).unionAll(docs(spark, ["a b c d e f", "k l m n o"]))
    assert sorted(r.text for r in jaccard_join.one_of_each(again).collect()) == ["a b c d e f", "k l m n o"]
    assert jaccard_join.jaccard_classes(docs(spark, [])).count() == 0


def test_every_linked_pair_shares_a_signature():
    rnd = random.Random(9)
    texts = near_copies(rnd, 40)
    block = next(blocks(pa.array(texts)))
    shingles, bounds = jaccard_join.shingle_sets(block, 3)
    sets = [set(shingles[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:])]
    for percent in (60, 80, 90):
        for hot in (np.empty(0, np.uint64), np.unique(shingles[::2])):
            of, value = jaccard_join.signatures(shingles, bounds, percent, hot)
            mine = [set(value[of == i].tolist()) for i in range(len(texts))]
            for i, j in itertools.combinations(range(len(texts)), 2):
                both = len(sets[i] & sets[j])
                if sets[i] != sets[j] and both and 100 * both >= percent * len(sets[i] | sets[j]):
                    assert mine[i] & mine[j]


# op6


def test_decontamination(spark):
    rnd = random.Random(6)
    vocabulary = [f"t{k}" for k in range(400)] + ["the", "of"] * 60
    items = [(i, prose(rnd, rnd.randint(8, 120), vocabulary).replace(".", "") + ". " + prose(rnd, 8, vocabulary).replace(".", "") + ".") for i in range(60)] + [(97, None), (98, ""), (99, "One two three four five six seven")]
    texts, planted = [], set()
    for d in range(150):
        text = prose(rnd, rnd.randint(0, 300), vocabulary)
        if d % 3 == 0:
            i = rnd.randrange(60)
            cut = rnd.randint(0, len(text))
            text = text[:cut] + " " + items[i][1].upper() + "\n" + text[cut:]
            planted.add((d, i))
        texts.append(text)
    texts += ODD
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    df = docs(spark, texts, extra=True)
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect()}
    assert got == planted
    clean = decontaminate.without_leaks(df, bench)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {d for d, _ in planted}
    assert decontaminate.leaks(df.limit(0), bench).count() == 0 and decontaminate.leaks(df, bench.limit(0)).count() == 0


def test_bounds_never_hide_a_match(spark, monkeypatch):
    """Retrieval with blocks equals scoring every passage against every segment."""
    rnd = random.Random(8)
    vocabulary = [f"t{k}" for k in range(60)]
    items = [(i, prose(rnd, rnd.randint(5, 60), vocabulary)) for i in range(200)]
    index = decontaminate.build(items)
    monkeypatch.setattr(decontaminate, "OVERLAP", 0.0)
    texts = [prose(rnd, 100, vocabulary) for _ in range(10)] + [items[5][1]]
    for block in blocks(pa.array(texts)):
        got = {(d, i) for d, i, *_ in decontaminate.find(block, index)}
        w, h = decontaminate._hashed(block)
        expected = set()
        for d in range(len(block)):
            mine = h[w.first[d] : w.first[d + 1]]
            for at in range(0, len(mine), decontaminate.STRIDE):
                known = np.flatnonzero(np.isin(index.term, mine[at : at + decontaminate.PASSAGE]))
                postings = np.concatenate([np.arange(index.block_first[t, 0], index.block_first[t, -1]) for t in known])
                score = np.bincount(index.segment[postings], index.impact[postings], len(index.least))
                expected |= {(d, int(index.item[s])) for s in np.flatnonzero(score >= index.least - 1e-9)}
        assert got == expected


def test_decontamination_in_shards(spark, monkeypatch):
    """Any number of shards and of passes finds the same leaks with the same scores, in any script."""
    rnd = random.Random(10)
    items = [(i, prose(rnd, 30, [f"t{k}" for k in range(500)])) for i in range(40)]
    items += [(100 + i, prose(rnd, 30, [f"слово{k}" for k in range(300)])) for i in range(40)]
    items += [(200 + i, prose(rnd, 20, ["水" * (1 + k % 5) + chr(0x4E00 + k) for k in range(200)])) for i in range(20)]
    bench = spark.createDataFrame(items, "item_id bigint, text string").repartition(3)
    texts = [t + " and " + prose(rnd, 20) for _, t in items[:10] + items[40:50] + items[80:90]] + ["nothing of it"]
    df = docs(spark, texts)
    rows = lambda: sorted((r.doc_id, r.item_id, round(r.score, 9), r.question_overlap, r.answer_overlap) for r in decontaminate.leaks(df, bench).collect())
    whole = rows()
    assert len(list(decontaminate.shards(bench))) == 1
    assert {(d, i) for d, i, *_ in whole} == {(k, items[j][0]) for k, j in enumerate([*range(10), *range(40, 50), *range(80, 90)])}
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 300)
    monkeypatch.setattr(decontaminate, "PASS_SHARDS", 3)
    assert len(list(decontaminate.shards(bench))) > 6
    assert rows() == whole
    assert {r.doc_id for r in decontaminate.without_leaks(df, bench).collect()} == {30}


# op3


def test_license_scan(spark):
    texts = ODD + [
        "Released under the MIT License.", "see cc-by, CC BY; gnu GENERAL public\nlicense and Apache License", "mitlicense mit_license mit license",
        "foo " * 40 + "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.",
        "Permission is hereby granted, free of charge, to any other person obtaining a copy of this software and its associated documentation files (the \"Software\"), to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "this work is licensed under nothing", "license license cc by cc by",
    ]
    phrases = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
    rows = {r.doc_id: r for r in license_scan.scan(docs(spark, texts, extra=True)).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        hits = [(k, label) for p, label in phrases for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r, starts = rows[i], [k for k, _ in hits]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(hits), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in hits})) and 0 <= r.score <= 1
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    n = len(ODD)
    assert rows[n + 3].labels == "gpl,gpl-3.0" and rows[n + 4].labels == "cc-by,cc-by-nc-4.0"
    assert rows[n + 5].labels == "mit" and rows[n + 5].score > 0.75 and rows[n + 6].labels == ""
    assert license_scan.scan(docs(spark, [])).count() == 0


def brute_spans(text):
    """Votes, bands, windows and spans by loops over the words."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    out, k = [], license_scan.K
    for number, (notice, label) in enumerate(license_scan.NOTICES):
        v = re.findall(r"[a-z0-9]+", notice.lower())
        need = len(v) if len(v) <= license_scan.SHORT else int(np.ceil(license_scan.COVERAGE * len(v)))
        hits = [(a, b) for a in range(len(w) - k + 1) for b in range(len(v) - k + 1) if w[a : a + k] == v[b : b + k]]
        diagonals = sorted({a - b for a, b in hits})
        bands = []
        for d in diagonals:
            if not bands or d - bands[-1][-1] > license_scan.NEIGHBOURS:
                bands.append([])
            bands[-1].append(d)
        for band in bands:
            windows = []
            for d in band:
                mine = [(a, b) for a, b in hits if a - b in band and d <= a and a + k <= d + 2 * len(v)]
                covered = len({b + i for _, b in mine for i in range(k)})
                if covered >= need:
                    windows.append((min(a for a, _ in mine), max(a for a, _ in mine) + k - 1, covered))
            groups, reached = [], -1
            for one in sorted(windows):
                if one[0] > reached:
                    groups.append([])
                groups[-1].append(one)
                reached = max(reached, one[1])
            out += [(number, label, *max(g, key=lambda x: (x[2], -x[0], -x[1]))) for g in groups]
    return sorted(out)


def test_license_spans_equal_brute_force(spark):
    rnd = random.Random(14)
    texts = ["GNU Lesser General " * 3 + "GNU Lesser General Public License", "GNU Lesser General Public License " * 3 + "and GNU Lesser", None, ""]
    for _ in range(25):
        parts = []
        for _ in range(rnd.randint(1, 5)):
            w = rnd.choice(license_scan.NOTICES)[0].split()
            a = 0 if rnd.random() < 0.6 else rnd.randrange(len(w))
            piece = w[a : len(w) if rnd.random() < 0.6 else rnd.randint(a, len(w))]
            for _ in range(rnd.randint(0, 1 + len(piece) // 15)):
                at = rnd.randrange(len(piece) + 1)
                piece[at : at + rnd.randint(0, 1)] = ["own"] * rnd.randint(0, 2)
            parts += [*piece, *(["between"] * rnd.choice((0, 0, 3)))]
        texts.append(" ".join(parts))
    found = collections.defaultdict(list)
    for r in license_scan.spans(docs(spark, texts, extra=True)).collect():
        found[r["key"]].append((r.notice, r.label, r.first_word, r.last_word, r.covered))
    for i, t in enumerate(texts):
        assert sorted(found[i]) == brute_spans(t)
    assert found[0] and found[0][0][1] == "lgpl" and len(found[1]) == 3


# op1


def page(body, title="t"):
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{body}</body></html>"


def test_main_text(spark):
    rnd = random.Random(11)
    pages, expected = [], []
    for i in range(12):
        paragraphs = [prose(rnd, 12) for _ in range(rnd.randint(1, 4))]
        body = f"<nav><a href=/>{prose(rnd, 2)}</a></nav><article><h1>Title {i} &amp; &eacute;</h1>" + "".join(f"<p>{html.escape(p)}\n  <b>bold</b>" for p in paragraphs)
        body += "<p>Always the same closing words</p><div class=comments><p>first!</p></div></article><footer>&copy; me</footer>"
        pages.append((i, "http://one.example/" + str(i), page(body)))
        expected.append("\n".join([f"Title {i} & é", *[f"{p} bold" for p in paragraphs]]))
    for i in range(12, 20):  # no marks at all: only the template tells
        text = prose(rnd, 30)
        pages.append((i, f"http://two.example/{i}", page(f"<div><div>Site name and motto</div><div><div><p>{text}</p></div></div><div>All rights kept</div></div>")))
        expected.append(text)
    pages += [(20, None, None), (21, "x", ""), (22, "http://three.example/", page("<header>Top</header><form>a</form><p>Alone <br> here<!-- c --></p><aside>side</aside>")), (23, "http://four.example", "no markup &lt;at all")]
    expected += ["", "", "Alone here", "no markup <at all"]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("key", F.lit(1)).withColumn("text", F.lit("x"))
    rows = {r.page_id: r for r in wrapper.extract(df).collect()}
    for i, e in enumerate(expected):
        assert rows[i].text == e and rows[i].n_chars == len(e)
    assert wrapper.extract(df.limit(0)).count() == 0
    copies = spark.createDataFrame([(i, "http://c.example/", page("<article><p>A copied text</p></article>")) for i in range(30)], "page_id bigint, url string, html string")
    assert {r.text for r in wrapper.extract(copies).collect()} == {"A copied text"}


def own_text(source, marks=True):
    """The text of a page that has no host: by its own tree and marks."""
    return wrapper.main_text(wrapper.Reader(marks), source, None, None, set()).split("\n")


def test_broken_pages_do_not_crash():
    rnd = random.Random(12)
    bits = ["<p>", "</p>", "<b>", "<div class='a", "\">", "</div>", "<!--", "-->", "<script>", "</script>", "text", "&amp", "&#x41;", "<", ">", "<li>", "<ul>", "<table><tr><td>", "<![CDATA[x]]>", "<a href=1>", "</a>", "<article>", "<br/>"]
    for _ in range(2000):
        source = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25)))
        for marks in (True, False):
            own_text(source, marks)


def test_deep_and_hostile_pages(spark):
    sources = [
        "<div>" * 20_000 + "x", "<section>" * 8_000 + "</p>" * 100_000 + "x", "<p><object>" + "<blockquote>" * 8_000 + "<p></p>" * 8_000 + "</object>x",
        "<a " * 100_000, '<a ">' + '"><a" ' * 50_000, "<title>" * 100_000 + "x", "<div>a</div><p>b</p>" * 5_000,
        "".join(f"<div class={chr(97 + i % 26)}{chr(97 + i // 26 % 26)}x{chr(97 + i // 676)}>t</div>" for i in range(4_000)), "<p>" + "word " * 300_000,
    ]
    reader = wrapper.Reader()
    for source in sources:
        begun = time.perf_counter()
        page, shape = reader.page(source)
        mine = shape[id(page.root)]
        own = reader.own_region(page, shape)
        assert list(reader.trees.carried(mine, mine)) and own is not None
        assert time.perf_counter() - begun < 2.0  # each is under a second on an idle machine
    df = spark.createDataFrame([(i, "http://h.example/", s) for i, s in enumerate(sources)], "page_id bigint, url string, html string")
    rows = {r.page_id: r.text for r in wrapper.extract(df).collect()}
    assert len(rows) == len(sources) and rows[0] == "x" and len(rows[8]) == 5 * 300_000 - 1


def soup(rnd, i, name):
    """(html, article): a page whose elements say nothing; a motto and a closing line are the site's, a menu, an aside and a
    footer vary from page to page."""
    paragraphs = [prose(rnd, rnd.randint(15, 60)) for _ in range(rnd.randint(1, 6))]
    title = f"Title {i} of it"
    menu = "".join(f"<div>{prose(rnd, 2)}</div>" for _ in range(4))
    article = f"<h2>{title}</h2>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "<p>Read on at our shop, as ever</p>"
    body = f"<div class=k1><div>{name}, site of sites</div></div><div class=k2>{menu}</div><div class=k3><div class=k4>{article}</div><div class=k5>{prose(rnd, 12)}</div></div><div class=k6><p>{prose(rnd, 9)}</p><p>All rights kept</p></div>"
    return page(body), "\n".join([title, *paragraphs])


@pytest.mark.parametrize("size", [1, 3, 12, 40])
def test_the_template_decides(spark, size):
    """Without any mark the alignment finds the article; without the alignment nothing does."""
    rnd = random.Random(size)
    pages, expected = [], {}
    for host in range(8):
        for i in range(size):
            source, text = soup(rnd, i, f"Host {host}")
            # The closing line of the article can only be told from it on hosts of several pages.
            expected[len(pages)] = text if size >= 4 else text + "\nRead on at our shop, as ever"
            pages.append((len(pages), f"http://host{host}.example/{i}", source))
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    right = lambda **how: np.mean([r.text == expected[r.page_id] for r in wrapper.extract(df, **how).collect()])
    assert right(marks=False) >= 0.95 and right() >= 0.95
    assert right(template=False) == 0.0 and right(marks=False, template=False) == 0.0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_what_marks_and_template_do_on_the_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")  # most of its 250 pages are alone on their host
    text = lambda **how: {r.page_id: r.text for r in wrapper.extract(pages, **how).collect()}
    both, alone, nothing = text(), text(marks=False), text(marks=False, template=False)
    assert np.mean([both[k] == alone[k] for k in both]) >= 0.95 and np.mean([both[k] == nothing[k] for k in both]) <= 0.05


def brute_constants(pages):
    """Texts at one place of nearly all different pages; all pages of the test have one skeleton."""
    seen = collections.defaultdict(set)
    for source in pages:
        root = html_tree.parse(source)
        path = {id(root): ""}
        order = [root]
        for node in order:
            for label, members in trees.runs(node):
                for m in members:
                    path[id(m)] = f"{path[id(node)]}/{label}"
                order += members
        for node, text, _ in html_tree.blocks(root):
            seen[path[id(node)], text].add(source)
    return {text for (_, text), on in seen.items() if len(on) >= wrapper.SHARE * (len(set(pages)) + 1)}


def test_constants_equal_brute_force(spark):
    rnd = random.Random(21)
    for size in (1, 3, 4, 5, 9, 30):
        pages = []
        for i in range(size):
            lines = [f"Own words {i}-{k} " + prose(rnd, 9) for k in range(3)]
            lines += [f"Shared {k}" if rnd.random() < 0.85 else f"Not shared {i} {k}" for k in range(6)]
            pages.append(page("<div><div>" + "".join(f"<p>{x}</p>" for x in lines) + "</div></div>"))
        gone = brute_constants(pages)
        df = spark.createDataFrame([(i, "http://one.example/", p) for i, p in enumerate(pages + pages)], "page_id bigint, url string, html string")
        for r in wrapper.extract(df).collect():
            wanted = [t for _, t, _ in html_tree.blocks(html_tree.parse((pages + pages)[r.page_id])) if t not in gone]
            assert r.text == "\n".join(wanted)


def test_marks_of_the_whole_page_remove_nothing():
    text = "<p>The whole text of the page.</p>"
    wrappers = (
        '<body class="right-sidebar">{}</body>', '<body class="single no-sidebar"><div>{}</div></body>', '<body><div id="page" class="has-banner">{}</div></body>',
        '<body><form action="x"><div>{}</div></form></body>', '<body><div class="site">{}</div></body>', '<body class="top">{}</body>',
    )
    for outer in wrappers:
        for inner in (text, f"<article>{text}</article>", f'<div class="ad">Buy!</div>{text}<div class="comments"><p>Nice</p></div>'):
            assert own_text(outer.format(inner)) == ["The whole text of the page."]
    # An article in a marked element that does not hold most of the text; comments that do.
    short = f'<div class="has-banner"><article>{text}</article></div><div>{"Other words here. " * 9}</div>'
    long = f'<div>{text}</div><div class="comments">{"<p>Yes, I think so too.</p>" * 9}</div>'
    for source in (short, long):
        assert own_text(source) == ["The whole text of the page."]
    assert own_text(f'<div class="widget">{text}</div>') == ["The whole text of the page."]


def test_split_articles_and_lists_of_references():
    split = '<body><div class="content"><p>First, the longer half of it.</p></div><div class="ad">Buy!</div><div class="content"><p>Second half.</p></div><div>About us</div></body>'
    assert own_text(split) == ["First, the longer half of it.", "Second half."]
    linked = '<body><div><a href="/">Home</a></div><div><p>See these.</p><ul><li><a href="1">One work</a></li><li><a href="2">Two works</a></li></ul><p>That is all.</p></div><div><a href="/x">More</a></div></body>'
    assert own_text(linked) == ["See these.", "One work", "Two works", "That is all."]
    last = linked.replace("<p>That is all.</p>", "")
    assert own_text(last) == ["See these.", "One work", "Two works"]


def brute_match(a, b):
    """Simple tree matching by its definition, on nested tuples."""
    if a[0] != b[0]:
        return 0
    best = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
    for i, x in enumerate(a[1]):
        for j, y in enumerate(b[1]):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + brute_match(x, y))
    return best[-1][-1] + 1


def test_simple_tree_matching(monkeypatch):
    rnd = random.Random(13)

    def grow(depth):
        return rnd.choice("xyz"), tuple(grow(depth - 1) for _ in range(rnd.randint(0, 4))) if depth else ()

    def number(t, n):
        return t.make(n[0], tuple(number(t, k) for k in n[1]))

    for _ in range(300):
        t, a, b = trees.Trees(), ("r", grow(3)[1]), ("r", grow(3)[1])
        x, y = number(t, a), number(t, b)
        assert t.match(x, y) == brute_match(a, b) == t.match(y, x)
        both = t.merge(x, y)
        assert t.match(both, x) == t.size[x] and t.match(both, y) == t.size[y]
        assert t.size[both] == t.size[x] + t.size[y] - t.match(x, y)
        assert t.load(t.dump(both)) == both and len(list(t.walk(both))) == t.size[both]
        monkeypatch.setattr(trees, "PAIRS", 3)  # the greedy way still keeps order and labels
        greedy = trees.Trees()
        x, y = number(greedy, a), number(greedy, b)
        at = [i for i in greedy.align(x, y) if i >= 0]
        assert at == sorted(set(at)) and greedy.match(x, y) <= brute_match(a, b)
        monkeypatch.undo()


def test_wide_trees_are_aligned_like_narrow_ones(monkeypatch):
    rnd = random.Random(14)

    def number(t, n):
        return t.make(n[0], tuple(number(t, k) for k in n[1]))

    def some(n):
        return "r", tuple((rnd.choice("xyz"), tuple((rnd.choice("uv"), ()) for _ in range(rnd.randint(0, 2)))) for _ in range(n))

    for n, m in [(rnd.randint(1, 9), rnd.randint(1, 9)) for _ in range(200)] + [(90, 60)]:
        a, b = some(n), some(m)
        plain, wide = trees.Trees(), trees.Trees()
        x, y = number(plain, a), number(plain, b)
        expected = plain.match(x, y), plain.align(x, y), plain.dump(plain.merge(x, y))
        monkeypatch.setattr(trees, "PAIRS", 3)
        x, y = number(wide, a), number(wide, b)
        assert (wide.match(x, y), wide.align(x, y), wide.dump(wide.merge(x, y))) == expected
        monkeypatch.undo()


def test_wrappers_do_not_depend_on_the_order_of_pages(spark):
    """Pages of one article that differ beside it all count, whichever comes first in a partition."""
    words_of = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    page = lambda k, side: f"<html><body><div><p>{side}</p></div><section><p>{words_of(k)}</p><p>{words_of(k + 100)}</p></section></body></html>"
    rows = [(10 * k + i, f"http://h.example/{k}/{i}", page(k, side)) for k in range(10) for i, side in enumerate(("Spring offers", "Autumn offers"))]
    found = []
    for order in (rows, rows[::-1]):
        pages = spark.createDataFrame(order, "page_id bigint, url string, html string").coalesce(1).withColumn("host", F.lit("h.example"))
        (r,) = wrapper.induce(pages).collect()
        found.append((r.template, r.regions, sorted(r.constants or ())))
    assert found[0] == found[1] and len(found[0][2]) == 2


def test_signatures_leave_in_small_batches(spark, monkeypatch):
    """A task does not hold all columns of all its signatures at once."""
    found = []
    monkeypatch.setattr(jaccard_join, "hot_shingles", lambda *_: np.empty(0, np.uint64))
    monkeypatch.setattr(jaccard_join, "OUT_ROWS", 50, raising=False)
    monkeypatch.setattr(jaccard_join, "per_partition", lambda df, function, schema, owner=None: found.append(function) or spark.createDataFrame([], schema))
    docs = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    jaccard_join._candidates(docs, 3, 80, "doc_id", "text")
    texts = [" ".join(f"w{i + k}" for i in range(60)) for k in range(40)]
    batch = pa.RecordBatch.from_pydict({"doc": list(range(40)), "text": texts, "text_hash": list(range(40))})
    sizes = [len(out["a"]) for out in found[0](iter([batch]))]
    assert max(sizes) <= 50 and sum(sizes) > 200


# very long texts and clashing columns


def test_texts_longer_than_a_block(spark):
    rnd = random.Random(31)
    long = " ".join(f"w{rnd.randrange(60_000)}" for _ in range(250_000))
    item = prose(rnd, 25, [f"own{k}" for k in range(300)])
    texts = [long + " " + item, long + " MIT License", "A short text of its own here", None]
    assert len(long) > 1 << 20
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    df = docs(spark, texts, extra=True).withColumns({c: F.lit(0) for c in ("text_hash", "log_weight", "sample_key", "component_id", "n_tokens", "hit", "counted", "low", "base")})
    licenses = {r.doc_id: r for r in license_scan.scan(df).collect()}
    assert [licenses[i].n_words for i in range(4)] == [len(w) for w in split] and licenses[1].first_word == 250_000
    rules = {r.doc_id: r for r in quality_rules.judge(df, boosting.constant(1.0)).collect()}
    assert all((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_statistics(texts[i]) for i, r in rules.items())
    back = {r.doc_id: bytes(r.decoded) for r in byte_bpe.decode(byte_bpe.encode(df, RANKS), RANKS).collect()}
    assert all(back[i] == (t or "").encode() for i, t in enumerate(texts))
    bench = spark.createDataFrame([(1, item), (2, long)], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect()} == {(0, 1), (0, 2), (1, 2)}
    classes = {r.doc: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_classes(df, size=3, percent=90).collect()}
    assert [classes[i] for i in range(4)] == brute_components(texts, 3, 90) and classes[1][1] == 0
    known = labels(spark, [(0, 1, 0), (2, 0, 0)])
    assert {r.doc_id: r.n_words for r in importance.resample(df, known).collect()} == {i: len(w) for i, w in enumerate(split)}
    assert importance.drawn(df, known).columns == df.columns and quality_rules.rejected_go(df, known).columns == df.columns
    target, background = lm_score.models(df, known)
    scores = {r.doc_id: r for r in lm_score.score(df, target, background).collect()}
    assert [scores[i].n_tokens for i in range(4)] == [len(w) for w in split] and scores[1].background_loss < scores[2].background_loss


# the registry


def test_registered_queries():
    names = queries.queries()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert set(queries.oracle_sql()) <= set(names)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = queries.queries()[name](spark, SF)
    cursor = con.execute(queries.oracle_sql()[name])
    theirs = [d[0] for d in cursor.description]
    assert sorted(theirs) == sorted(got.columns)
    assert sorted(map(repr, cursor.fetchall())) == sorted(repr(tuple(r[c] for c in theirs)) for r in got.collect())
