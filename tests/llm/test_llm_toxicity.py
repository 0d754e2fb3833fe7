"""The toxicity models against plain Python: counts, discounts, shares, evidence, the fit and the scores."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkloom.llm import toxicity


class Plain:
    """The models with dictionaries; ``rows`` are (text, label)."""

    def __init__(self, rows):
        self.words = (Counter(), Counter())
        for text, label in rows:
            self.words[label].update(tokens(text))
        self.stems = tuple(Counter(w.encode()[:5] for w in c) for c in self.words)
        self.discounts = [self._discounts(level) for level in (self.words, self.stems)]
        n = [len(c) for c in self.stems]
        self.share = (n[1] + 0.5) / (n[0] + n[1] + 1)

    @staticmethod
    def _discounts(level):
        c = Counter(v for classes in level for v in classes.values())
        n = [None, *(max(c[k], 1) for k in (1, 2, 3, 4))]
        y = n[1] / (n[1] + 2 * n[2])
        found = [k - (k + 1) * y * n[k + 1] / n[k] for k in (1, 2, 3)]
        return [0, *(min(max(d, 0.1), k - 0.05) for k, d in enumerate(found, 1))]

    def differences(self, text, label=None):
        own = Counter(tokens(text))
        words = [dict(c) for c in self.words]
        stems = [dict(c) for c in self.stems]
        if label is not None:
            for w, n in own.items():
                words[label][w] = words[label].get(w, 0) - n
                if words[label][w] <= 0:
                    stems[label][w.encode()[:5]] = stems[label].get(w.encode()[:5], 0) - 1
        out = []
        for w in tokens(text):
            share = self.share
            for table, key, d in ((stems, w.encode()[:5], self.discounts[1]), (words, w, self.discounts[0])):
                ordinary, toxic = (max(t.get(key, 0), 0) for t in table)
                if toxic + ordinary:
                    d1, d0 = d[min(toxic, 3)], d[min(ordinary, 3)]
                    share = (toxic - d1 + (d1 + d0) * share) / (toxic + ordinary)
            x = math.log(share / self.share) - math.log((1 - share) / (1 - self.share))
            out.append(min(max(x, -12), 12))
        return out

    def evidence(self, text, label=None):
        x = self.differences(text, label)
        if not x:
            return [0.0] * 6
        mean = sum(x) / len(x)
        out = [mean, math.sqrt(sum((v - mean) ** 2 for v in x) / len(x))]
        for width in (1, 2, 4, 16):
            windows = [sum(x[k : k + width]) for k in range(max(1, len(x) - width + 1))]
            out.append(math.log(sum(map(math.exp, windows)) / len(windows)))
        return out


def tokens(text):
    return [m.decode("utf-8", "replace") for m in re.findall(rb"[a-z0-9'\x80-\xff]+", (text or "").encode().lower())]


def made_rows(count=140):
    rand = random.Random(5)
    usual = ["".join(rand.choices("abcdeé", k=rand.randrange(1, 8))) for _ in range(400)]
    foul = ["rotten", "rottenly", "rottenest", "vile", "vileness"]
    rows = []
    for k in range(count):
        words = rand.choices(usual, k=rand.randrange(0, 60))
        if k % 4 == 0:
            for _ in range(rand.randrange(1, 4)):
                words.insert(rand.randrange(len(words) + 1), rand.choice(foul).title())
        rows.append((k, rand.choice([" ", ", ", "\n"]).join(words), int(k % 4 == 0)))
    return [*rows, (count, None, 0), (count + 1, "", 1), (count + 2, "...", 0)]


@pytest.mark.parametrize("most,bits", [(toxicity.MOST_SENT, 1 << 28), (200, 1 << 28), (200, 64), (0, 1 << 12)])
def test_evidence_equals_plain(spark, monkeypatch, most, bits):
    monkeypatch.setattr(toxicity, "MOST_SENT", most)
    monkeypatch.setattr(toxicity, "FILTER_BITS", max(bits, 1 << 10))
    rows = made_rows()
    learnt = spark.createDataFrame(rows[::2], "doc_id long, text string, label int").repartition(3)
    plain = Plain([(t, y) for _, t, y in rows[::2]])
    scorer = toxicity.Scorer(learnt)
    assert np.allclose(scorer.smoothing.word, plain.discounts[0]) and np.allclose(scorer.smoothing.stem, plain.discounts[1])
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    found = {r.doc_id: r.evidence for r in scorer.evidence(docs, ["doc_id"]).collect()}
    own = {r.doc_id: r.evidence for r in scorer.evidence(learnt, ["doc_id"], "label").collect()}
    for k, text, label in rows:
        assert np.allclose(found[k], plain.evidence(text), atol=1e-9)
        if k in own:
            assert np.allclose(own[k], plain.evidence(text, label), atol=1e-9)
    assert len(found) == len(rows) and len(own) == len(rows[::2])


def test_scores_equal_a_plain_fit(spark, docs_of):
    rows = made_rows()
    docs = docs_of([r[:2] for r in rows])
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    learnable = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    plain = Plain([(t, y) for _, t, y in learnable])
    x = np.array([plain.evidence(t, y) for _, t, y in learnable])
    y = np.array([r[2] for r in learnable], float)
    mean, scale = x.mean(0), x.std(0)
    beta = np.zeros(7)
    for _ in range(20_000):  # plain steps downhill
        chance = 1 / (1 + np.exp(-(((x - mean) / scale) @ beta[:6] + beta[6])))
        slope = np.append(((x - mean) / scale).T @ (chance - y) + beta[:6], (chance - y).sum() + 1e-6 * beta[6])
        beta -= 0.01 * slope
    found = toxicity.score_toxicity(docs, labels).collect()
    text = {k: t for k, t, _ in rows}
    for r in found:
        logit = ((np.array(plain.evidence(text[r.doc_id])) - mean) / scale) @ beta[:6] + beta[6]
        assert abs(r.score - 1 / (1 + math.exp(-logit))) < 1e-4
        assert r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    assert len(found) == len(rows)


def test_length_is_no_evidence(spark):
    rows = made_rows()
    learnt = spark.createDataFrame([(t, y) for _, t, y in rows], "text string, label int")
    ordinary = [t for _, t, y in rows if t and not y]
    docs = spark.createDataFrame([(1, " ".join(ordinary[:5])), (2, " ".join(ordinary[:5] * 200))], "doc_id long, text string")
    short, long = (r.evidence for r in toxicity.Scorer(learnt).evidence(docs, ["doc_id"]).orderBy("doc_id").collect())
    assert np.allclose(short[:3], long[:3], atol=0.01)


def test_without_toxic_takes_toxic_rows_only(spark, docs_of):
    rows = made_rows()
    docs = docs_of([*(r[:2] for r in rows), (None, rows[0][1])]).withColumn("label", F.lit("x")).withColumn("evidence", F.lit(1))
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    toxic = {r.doc_id for r in toxicity.score_toxicity(docs, labels).where("predicted = 1 and doc_id is not null").collect()}
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted([*(str(k) for k, _, _ in rows if k not in toxic), "None"])
    assert len(toxic) > 20


def test_long_texts_and_many_words(spark):
    text = " ".join(f"w{k}" for k in range(250_000))
    learnt = spark.createDataFrame([("a b vile", 1), ("a b c", 0)], "text string, label int")
    docs = spark.createDataFrame([(1, text), (2, "vile"), (3, text)], "doc_id long, text string").coalesce(1)
    found = {r.doc_id: r.evidence for r in toxicity.Scorer(learnt).evidence(docs, ["doc_id"]).collect()}
    assert found[1] == found[3] and found[2][0] > found[1][0]
