"""The corpus pipeline from end to end on a small corpus, each stage against plain Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from talkloom.llm import decontaminate, neardup, toxicity
from talkloom.llm.queries import tokenizer_path

FOUL = ["rotten", "rottenly", "vile", "vileness", "rottenest"]


def made_tables(seed=4):
    rand = random.Random(seed)
    usual = ["".join(rand.choices("abcdefg", k=rand.randrange(2, 8))) for _ in range(500)]
    text = lambda n: rand.choices(usual, k=n)
    items = [(k, " ".join(text(20))) for k in range(3)]
    docs, labels = [], []
    for k in range(240):
        words = text(rand.randrange(8, 60))
        if k % 5 == 0:
            for _ in range(4):
                words.insert(rand.randrange(len(words)), rand.choice(FOUL))
        if k % 40 == 1:
            words += items[k % 3][1].split() + text(5)
        docs.append((k, " ".join(words), "en", rand.choice(["a", "a", "a", "b", None])))
        labels.append((k, 1, int(k % 5 == 0)))
    for k in range(30):  # near copies, one word changed, and exact ones
        words = docs[41 + k][1].split()
        if k % 2:
            words[-1] = "changed"
        docs.append((1000 + k, " ".join(words), "en", "b"))
    return [*docs, (2000, None, "en", "a"), (2001, "", None, "b"), (2002, "two words", "en", None)], labels, items


def shingles(text):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def lowest_of_groups(rows):
    sets = {d: shingles(t) for d, t, *_ in rows}
    low = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if sets[a] and a < b and 100 * both >= neardup.PERCENT * len(sets[a] | sets[b]) and low[a] != low[b]:
                    low[a] = low[b] = min(low[a], low[b])
                    changed = True
    return {d for d in low if low[d] == d}


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, labels, items = made_tables()
    folder = str(tmp_path_factory.mktemp("corpus"))
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) as long) as n_chars")
    frame.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    seen, plain = [], corpus_pipeline.written
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(corpus_pipeline, "written", lambda df, tag: seen.append(plain(df, tag)) or seen[-1])
        last = corpus_pipeline.run(spark, folder).collect()
    tables = [sorted(((r.doc_id, r.text, r.lang, r.source) for r in df.collect()), key=str) for df in seen]
    assert all(df.columns == frame.columns for df in seen)
    return docs, labels, items, frame, tables, last


def test_toxic_rows_go(spark, stages):
    docs, labels, _, frame, tables, _ = stages
    verdicts = toxicity.score_toxicity(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    toxic = {r.doc_id for r in verdicts.where("predicted = 1").collect()}
    assert tables[0] == sorted((d for d in docs if d[0] not in toxic), key=str)
    assert toxic >= {k for k, _, y in labels if y} and len(toxic) < 60


def test_one_of_each_group_and_no_leak_stays(stages):
    _, _, items, _, tables, _ = stages
    kept = lowest_of_groups(tables[0])
    assert tables[1] == [d for d in tables[0] if d[0] in kept] and len(tables[1]) < len(tables[0])
    leaked = {d[0] for d in tables[1] for _, item in items if 100 * len(shingles(item) & shingles(d[1])) >= decontaminate.PERCENT * len(shingles(item))}
    assert tables[2] == [d for d in tables[1] if d[0] not in leaked] and leaked


def test_sources_are_mixed_to_their_targets(stages):
    *_, tables, _ = stages
    size = lambda d: len((d[1] or "").split())
    sizes, taken, copies = Counter(), Counter(), Counter(tables[3])
    for d in tables[2]:
        sizes[d[3]] += size(d)
    for d in tables[3]:
        taken[d[3]] += size(d)
    weights = {s: k % 3 + 1 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, open_ = {}, set(sizes)
    while True:
        level = (sum(sizes.values()) - sum(target.values())) / sum(weights[s] for s in open_)
        above = {s for s in open_ if 3 * sizes[s] < level * weights[s]}
        if not above:
            break
        target |= {s: 3 * sizes[s] for s in above}
        open_ -= above
    target |= {s: level * weights[s] for s in open_}
    assert all(abs(taken[s] - target[s]) <= 60 for s in sizes) and set(copies) <= set(tables[2]) and max(copies.values()) <= 3


def test_ids_are_those_of_the_tokenizer(stages):
    from tokenizers import Tokenizer

    *_, tables, last = stages
    tokenizer, start, expected = Tokenizer.from_file(tokenizer_path()), 0, []
    for doc, text, *_ in sorted(tables[3], key=lambda d: (d[0], d[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        expected.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in last) == sorted(expected)
