"""Near-duplicates and decontamination against brute force, and their edge rows."""

import random

import numpy as np
import pytest

from talkloom.llm import decontaminate, neardup
from talkloom.llm.components import components
from talkloom.llm.text import WordHashes, lower_words, shingle_hashes

VOCABULARY = [f"w{k}" for k in range(400)]


def shingles(text):
    words = (text or "").encode().lower().split()
    span = min(5, len(words))
    return {tuple(words[i : i + span]) for i in range(len(words) - span + 1)} if words else set()


def near_copies(seed=3):
    """Families of edited copies, edited copies of copies, exact copies, and unrelated texts."""
    rand = random.Random(seed)
    rows, doc = [], 0
    for size in (70, 6, 2, 1, 1, 1):
        base = rand.choices(VOCABULARY, k=120)
        for _ in range(size):
            words = list(base)
            for _ in range(rand.choice([0, 1, 2, 3, 4, 5])):
                words[rand.randrange(len(words))] = rand.choice(VOCABULARY)
            rows.append((doc, " ".join(words)))
            doc += 1
    rows += [(900, None), (901, ""), (902, " \n\t "), (903, "One two"), (904, "one  TWO"), (905, "one two three"), (906, rows[0][1].upper())]
    return rows


def expected_groups(rows):
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                p, q = top(a), top(b)
                root[max(p, q)] = min(p, q)
    return {(d, len(sets[d]), top(d), top(d) == d) for d in ids}


def test_groups_equal_brute_force(docs_of):
    rows = near_copies()
    assert {tuple(r) for r in neardup.near_duplicate_groups(docs_of(rows)).collect()} == expected_groups(rows)


def test_crowded_buckets_give_the_same_groups(docs_of, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL_BUCKET", 1)
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 7)
    rows = near_copies(5)
    assert {tuple(r) for r in neardup.near_duplicate_groups(docs_of(rows)).collect()} == expected_groups(rows)


def test_common_counts_agree():
    rand = np.random.default_rng(1)
    sets = [np.unique(rand.integers(0, 60, 30).astype(np.uint64)) for _ in range(12)]
    a, b = np.nonzero(~np.eye(12, dtype=bool))
    place = np.arange(12)
    few = np.array([len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b, strict=True)])
    many = neardup._common(sets, place, place, np.tile(a, 2), np.tile(b, 2))
    assert (many == np.tile(few, 2)).all()


def test_pruning_keeps_pairs_at_the_threshold():
    for places in (16, 64, 128):
        least = neardup.needed_matches(places, 75, 1e-6)
        assert 0 < least < 0.75 * places


def test_empty_and_clashing_columns(spark, docs_of):
    none = docs_of([(1, "a")]).where("doc_id < 0")
    assert neardup.near_duplicate_groups(none).count() == 0
    odd = docs_of([(1, "a b"), (2, "A  b"), (None, "c")]).selectExpr("*", "1 as cls", "2 as digest", "3 as component_id", "4 as _gone")
    kept = neardup.without_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1]


def test_rows_without_an_id_are_shingled_once_each(spark, docs_of, tmp_path, monkeypatch):
    """Many near copies with null ids, and one text many times: texts read again for the exact check stay few."""
    rand = random.Random(9)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for k in range(400):
        words = list(base)
        words[rand.randrange(60)] = f"x{k}"
        texts.append(" ".join(words))
    rows = [(None, t) for t in texts] + [(None, texts[0])] * 300 + [(5, texts[1])] * 300 + [(None, "quite another text of some words")]
    log = tmp_path / "log"
    plain = neardup._full_sets

    def counted(batches):
        def logged():
            for batch in batches:
                with open(log, "a") as out:
                    out.write(f"{batch.num_rows}\n")
                yield batch

        yield from plain(logged())

    monkeypatch.setattr(neardup, "_full_sets", counted)
    found = neardup.near_duplicate_groups(docs_of(rows)).collect()
    groups = {(r.component_id, r.kept) for r in found if r.n_shingles == 56}
    assert len(found) == len(rows) and groups == {(5, True), (5, False)}
    assert sum(map(int, log.read_text().split())) <= 2 * 401


def test_one_of_repeated_rows_stays(docs_of):
    rows = docs_of([(1, "a b c d e f"), (1, "a b c d e f"), (2, "x y z"), (3, None), (3, None)])
    assert sorted(r.doc_id for r in neardup.without_near_duplicates(rows).collect()) == [1, 2, 3, 3]


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(k + 1, k) for k in range(30)] + [(100, 101), (101, 101)], "a long, b long")
    found = {r.node: r.component for r in components(links).collect()}
    assert found == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100}


def planted():
    rand = random.Random(2)
    items = [(k, " ".join(rand.choices(VOCABULARY, k=n))) for k, n in enumerate([3, 5, 12, 30, 61, 200])]
    items += [(6, items[2][1].upper()), (7, ""), (8, None), (None, items[3][1])]
    rows = []
    for k in range(40):
        words = rand.choices(VOCABULARY, k=rand.choice([5, 80, 3000]))
        if k % 2:
            item = items[k // 2 % 6][1].split()
            at = rand.randrange(len(words))
            words[at:at] = item[: len(item) * 9 // 10 + 1]
        rows.append((k, " ".join(words)))
    return rows + [(100, items[0][1]), (101, None), (102, ""), (103, items[1][1])], items


def test_leaks_equal_brute_force(spark, docs_of):
    rows, items = planted()
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = set()
    for d, text in rows:
        own = shingles(text)
        for i, item in items:
            s = shingles(item)
            if s and 100 * len(s & own) >= 75 * len(s):
                expected.add((d, i, len(s), len(s & own), len(s & own) / len(s)))
    found = decontaminate.find_leaks(docs_of(rows), bench)
    assert {tuple(r) for r in found.collect()} == expected and len(expected) > 10


def test_no_short_item_is_missed_in_long_documents(spark, docs_of):
    rand = random.Random(9)
    texts = [rand.choices(VOCABULARY, k=3000) for _ in range(30)]
    items = []
    for k in range(1800):
        words, n = texts[k % 30], 5 + k % 2
        at = rand.randrange(len(words) - n)
        items.append((k, " ".join(words[at : at + n])))
    rows = [(d, " ".join(words)) for d, words in enumerate(texts)]
    sets = {d: shingles(t) for d, t in rows}
    expected = {(d, i) for i, t in items for d, own in sets.items() if shingles(t) <= own}
    found = decontaminate.find_leaks(docs_of(rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == expected and len(expected) >= 1800


def test_blocks_of_items_change_nothing(spark, docs_of, monkeypatch):
    rows, items = planted()
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = {tuple(r) for r in decontaminate.find_leaks(docs_of(rows), bench).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_SHINGLES", 50)
    assert {tuple(r) for r in decontaminate.find_leaks(docs_of(rows), bench).collect()} == whole


def test_no_items_or_documents(spark, docs_of):
    bench = spark.createDataFrame([(1, None)], "item_id long, text string")
    docs = docs_of([(1, "a b c d e f g")])
    assert decontaminate.find_leaks(docs, bench).count() == 0
    assert decontaminate.without_leaks(docs, bench).columns == docs.columns
    full = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    assert decontaminate.find_leaks(docs.where("doc_id > 5"), full).count() == 0
    assert decontaminate.without_leaks(docs.withColumn("_gone", docs.doc_id), full).count() == 0


def test_shingles_need_the_same_words_in_order():
    hashes = WordHashes(most=3)
    one = shingle_hashes(lower_words(b"A b c d e f"), hashes)
    assert len(set(one.tolist())) == 2
    assert not set(one.tolist()) & set(shingle_hashes(lower_words(b"b a c d e f"), hashes)[:1].tolist())
    assert shingle_hashes([], hashes).size == 0


@pytest.mark.parametrize("text,count", [(b"a b c d", 1), (b"a b c d e", 1), (b"a b c d e f", 2)])
def test_shingle_counts(text, count):
    assert len(shingle_hashes(lower_words(text), WordHashes())) == count
