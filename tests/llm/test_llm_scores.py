"""Scores, rules, mixing and url filters: held-out accuracy, brute force and edge rows."""

import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkloom.llm import mixing, quality, rules, toxicity, urls
from talkloom.llm.queries import LABELLED_URLS, URL_RULES

WORDS = [f"word{k}" for k in range(300)]
BAD = ["foulone", "foultwo", "foulthree"]


def labelled_texts(n=500):
    rand = random.Random(8)
    docs, labels = [], []
    for k in range(n):
        words = rand.choices(WORDS, k=rand.randrange(30, 120))
        toxic, junk = k % 4 == 0, k % 5 == 0
        if toxic:
            for _ in range(4):
                words.insert(rand.randrange(len(words)), rand.choice(BAD))
        docs.append((k, " ".join(w + "***" if junk else w for w in words)))
        labels.append((k, int(not junk), int(toxic)))
    docs += [(1000, None), (1001, ""), (1002, " "), (None, "no id"), (3, docs[3][1])]
    return docs, labels


@pytest.fixture(scope="module")
def scored_tables(spark, docs_of):
    docs, labels = labelled_texts()
    return docs_of(docs).withColumn("label", F.lit(7)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


@pytest.mark.parametrize("score,column", [(quality.score_quality, 1), (toxicity.score_toxicity, 2)])
def test_held_out_documents_are_told_apart(scored_tables, score, column):
    docs, labels, rows = scored_tables
    truth = {r[0]: r[column] for r in rows}
    found = score(docs, labels).collect()
    assert len(found) == 505 and all(0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert len(held) > 50
    right = sum(r.predicted == truth[r.doc_id] for r in held) / len(held)
    assert right > 0.97
    assert [r.held_out for r in found if r.doc_id is None] == [False]


def test_scores_without_labels_or_rows(spark, scored_tables):
    docs, labels, _ = scored_tables
    for score in (quality.score_quality, toxicity.score_toxicity):
        assert {r.score for r in score(docs, labels.where("doc_id < 0")).collect()} == {0.5}
        assert score(docs.where("doc_id < 0"), labels).count() == 0
    assert toxicity.without_toxic(docs, labels).columns == docs.columns


def test_isotonic_pools_violators():
    assert quality.isotonic(np.array([1.0, 1, 2]), np.array([1.0, 0, 2])).tolist() == [0.5, 0.5, 1.0]


def slow_counts(text):
    words = [w for w in (text or "").replace("\n", " ").split(" ") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [line for line in (text or "").split("\n") if line.strip()]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_rule_counts_equal_brute_force(docs_of):
    rand = random.Random(1)
    texts = ["".join(rand.choices(["a ", "b ", "c ", "é# ", "\n"], k=rand.randrange(60))) for _ in range(60)] + [None, "", "\n\n", "a a a a"]
    found = {r.doc_id: r for r in rules.judge(docs_of(list(enumerate(texts)))).collect()}
    for k, text in enumerate(texts):
        r = found[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == slow_counts(text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def test_fences_follow_their_group(spark):
    rand = random.Random(2)
    rows = []
    for k in range(600):
        words = rand.choices(WORDS, k=80)
        if k % 2:  # a source where symbols are usual
            words = [w + "#" for w in words]
        if k in (10, 11):
            words = [w + "##" for w in words]
        rows.append((k, " ".join(words), None, None if k % 2 else "plain"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_words", F.lit("x"))
    kept = {r.doc_id: r.kept for r in rules.judge(docs).collect()}
    assert not kept[10] and sum(not v for v in kept.values()) <= 2
    assert rules.judge(docs.where("doc_id < 0")).count() == 0


def test_fences_above_fifty_a_word_still_hold(docs_of):
    rand = random.Random(4)

    def text(length):
        return " ".join("".join(rand.choices("abcdefgh", k=length)) for _ in range(60))

    rows = [(k, text(20 if k % 5 else 30)) for k in range(300)]  # median 20, 0.9 quantile 30: a fence of 60
    rows += [(1000, text(10_000)), (1001, text(70)), (1002, text(55))]
    kept = {r.doc_id: r.kept for r in rules.judge(docs_of(rows)).collect()}
    assert [d for d, ok in sorted(kept.items()) if not ok] == [1000, 1001]


def test_bins_hold_their_values_and_are_few(spark):
    rows = spark.range(0, 70_000).selectExpr("id * id * id as v").select("v", rules.bin_low(F.col("v")).alias("low"), rules.bin_high(F.col("v")).alias("high"))
    found = rows.collect()
    assert all(r.low <= r.v <= r.high and r.high - r.low <= r.low / 2 ** (rules.BITS - 1) for r in found)
    assert all(r.low == r.high for r in found if r.v < 2**rules.BITS)
    assert len({r.low for r in found}) <= 2 ** (rules.BITS - 1) * (65 - rules.BITS)


def slow_fence(values, width):
    """The exact fence, and the widest one that the sketch may give."""
    ordered = sorted(values)
    median, high = ordered[(len(ordered) + 1) // 2 - 1], ordered[math.ceil(0.9 * len(ordered)) - 1]
    exact = max(high + rules.REACH * (high - median), median + width)
    return exact, exact + (2 * rules.REACH + 1) * high / 2 ** (rules.BITS - 1)


@pytest.mark.parametrize("n", [199, 200, 201])
def test_fences_do_not_jump_with_the_size_of_a_group(spark, n):
    rand = random.Random(7)
    own = [int(1000 * rand.uniform(4, 9)) for _ in range(n)]
    other = [int(1000 * rand.uniform(10, 40)) for _ in range(500)]
    rows = [("en", "own", m, v) for m in rules.MEASURES for v in own] + [("en", "other", m, v) for m in rules.MEASURES for v in other]
    values = spark.createDataFrame(rows, "lang string, source string, measure string, v long")
    counts = values.groupBy("lang", "source", "measure", rules.bin_low(F.col("v")).alias("bin")).agg(F.count("*").alias("n"))
    found = {r["_source"]: r for r in rules.fences(counts).collect()}
    for m, (_, _, width) in rules.MEASURES.items():
        sides = zip(slow_fence(own, width), slow_fence(own + other, width))
        # The language holds all texts, so its blend with them is itself.
        low, high = ((n * a + rules.PRIOR * b) / (n + rules.PRIOR) for a, b in sides)
        assert low - 1e-6 <= found["own"][f"_{m}"] <= high + 1e-6


def test_mix_reaches_targets(spark):
    rand = random.Random(3)
    rows = [(k, " ".join(["w"] * rand.randrange(0, 60)), None, s) for k, s in enumerate(rand.choices(["a", "b", "c", None], [70, 20, 3, 7], k=2000))]
    rows.append((5000, None, None, "a"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("size", F.lit("x"))
    one, two = (sorted(map(tuple, mixing.mix(d).collect())) for d in (docs, docs.repartition(7)))
    assert one == two and len(one) == len(rows)
    source = {k: s for k, _, _, s in rows}
    sizes, weights = {}, {"a": 1, "b": 2, "c": 3, None: 1}
    for d, size, *_ in one:
        sizes[source[d]] = sizes.get(source[d], 0) + size
    target, open_ = {}, set(sizes)
    while True:
        level = (sum(sizes.values()) - sum(target.values())) / sum(weights[s] for s in open_)
        above = {s for s in open_ if 3 * sizes[s] < level * weights[s]}
        if not above:
            break
        target |= {s: 3 * sizes[s] for s in above}
        open_ -= above
    target |= {s: level * weights[s] for s in open_}
    for s in sizes:
        own = [r for r in one if source[r[0]] == s]
        assert [r[3] for r in own] == pytest.approx([target[s]] * len(own))
        assert abs(sum(r[4] for r in own) - target[s]) <= 60 and all(r[4] <= 3 * r[1] for r in own)
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r[5] for r in one)
    assert mixing.mix(docs.where("doc_id < 0")).count() == 0 and mixing.mixed_rows(docs.where("doc_id < 0")).count() == 0


def test_rows_that_share_an_id_meet_the_target(spark):
    """Null, repeated and wholly repeated rows are taken one by one."""
    rows = [(None, " ".join(["w"] * 10) + f" {k}", None, "a") for k in range(300)]
    rows += [(7, " ".join(["w"] * 9), None, "b") for _ in range(400)]
    rows += [(None, "x y z", None, None) for _ in range(500)] + [(k, "u v", None, "c") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("at", F.lit(1)).withColumn("own", F.lit(2))
    taken, targets = Counter(), {}
    largest = {"a": 11, "b": 9, "c": 2, None: 3}
    found = mixing.mix(docs).collect()
    for r in found:
        source = {3300: "a", 3600: "b", 600: "c", 1500: None}[r.source_size]
        taken[source] += r.taken
        targets[source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    assert len(found) == len(rows) and all(abs(taken[s] - targets[s]) <= largest[s] for s in targets) and len(targets) == 4
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r.source] += len(r.text.split())
    assert words == taken
    assert sorted(map(str, mixing.mix(docs.repartition(5)).collect())) == sorted(map(str, found))


def test_url_rules(spark):
    rows = [(1, "http://A.com/x?y"), (2, "https://www.example.com/en/1"), (3, "https://m.example.com/en/1"), (4, "http://x.net/es/"), (5, "http://x.net/es"),
            (6, "no scheme"), (7, None), (8, "http://notcom/"), (9, "http://example.com"), (9, "http://spam-farm.example.org/es/1"), (10, "a://b.com:80/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'h' as host", "'p' as path")
    found = urls.judge_urls(pages, URL_RULES, urls.labelled_table(spark, LABELLED_URLS)).collect()
    by_id = {r.page_id: r for r in found}
    assert len(found) == len(rows)
    assert (by_id[1].host, by_id[1].path, by_id[1].rule, by_id[1].verdict) == ("a.com", "/x", "com/", "allow")
    assert (by_id[2].rule, by_id[2].verdict, by_id[3].rule, by_id[3].verdict) == ("www.example.com/en/", "allow", "example.com/en/", "block")
    assert by_id[4].rule == "net/es/" and by_id[5].rule is None
    assert all((by_id[k].host, by_id[k].path, by_id[k].rule) == ("", "", None) for k in (6, 7))
    assert by_id[8].rule is None and by_id[10].rule is None
    assert {r.verdict for r in found if "spam" in r.host} == {"block"}


def plain_fit(rows, rounds, bits):
    """The same steps with numpy over (n-grams, label)."""
    size, end = len(rows), 1 << bits
    x, y = np.zeros((size, end + 1)), np.array([label for _, label in rows], float)
    for i, (grams, _) in enumerate(rows):
        x[i, grams], x[i, end] = 1 / math.sqrt(max(len(grams), 1)), 1
    weight = np.where(y == 1, size / (2 * y.sum()), size / (2 * (size - y.sum())))
    bends = urls.RIDGE + (x * (weight * x.sum(1))[:, None]).sum(0) / 4 / size
    here = last = np.zeros(end + 1)
    pace, losses = 1.0, []
    for _ in range(rounds):
        faster = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        ahead, pace = here + (pace - 1) / faster * (here - last), faster
        slope = x.T @ (weight * (y - 1 / (1 + np.exp(-x @ ahead)))) / size
        slope[:end] -= urls.RIDGE * ahead[:end]
        last, here = here, ahead + slope / bends
        margins = x @ here
        losses.append((weight * np.log1p(np.exp(np.where(y == 1, -margins, margins)))).mean())
    assert losses[-1] < losses[0] / 3
    return here


def grams_of(spark, labelled):
    grams = urls.hashed_grams(urls.host_of(F.col("url")), urls.path_of(F.col("url")))
    return urls.labelled_table(spark, labelled).select("url", "label", grams.alias("grams"))


def test_url_model_equals_plain_steps_and_handles_long_urls(spark):
    some = LABELLED_URLS[::6]
    model = urls.fit(urls.labelled_table(spark, [*some, ("x", None)]), rounds=6)
    table = grams_of(spark, [*some, ("http://h/" + "long/" * 20000, 0)])
    rows = table.select("*", model.score(F.col("grams")).alias("score")).collect()
    plain = plain_fit([(r.grams, r.label) for r in rows[:-1]], 6, urls.BITS)
    for r in rows:
        margin = plain[r.grams].sum() / math.sqrt(len(r.grams)) + plain[-1]
        assert r.score == pytest.approx(1 / (1 + math.exp(-margin)), abs=2e-3)


def test_url_model_without_labels_or_with_one(spark):
    labelled = urls.labelled_table(spark, LABELLED_URLS[:3])
    none = urls.fit(labelled.where("label > 5"))
    assert set(none.weights) == {0.0} and none.bias == 0.0
    one = urls.fit(labelled, rounds=3)
    assert one.bias > 0 and sum(one.weights) > 0


def test_urls_outside_the_table_are_told_apart(spark):
    held = [r for r in LABELLED_URLS if crc32(r[0].encode()) % 4 == 0]
    hosts = [{url.split("//")[1].split("/")[0] for url, _ in rows} for rows in (held, set(LABELLED_URLS) - set(held))]
    assert len(set(LABELLED_URLS)) == len(LABELLED_URLS) and not hosts[0] & hosts[1]
    model = urls.fit(urls.labelled_table(spark, [r for r in LABELLED_URLS if r not in set(held)]))
    scored = grams_of(spark, held).select("label", (model.score(F.col("grams")) >= urls.CUT).alias("blocked")).collect()
    hits = sum(r.blocked and r.label == 1 for r in scored)
    assert hits >= 0.9 * sum(r.blocked for r in scored) and hits >= 0.9 * sum(r.label for r in scored)
