import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from talkloom.llm.divergence import audit_sources, terms

SCHEMA = "doc_id long, text string, lang string, source string"


def plain(rows, least_docs, top_terms=50, prior=5):
    """The audit in plain Python."""
    rows = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source in rows]
    docs, lang_counts, counts = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, found in rows:
        docs[lang].update(set(found))
        lang_counts[lang].update(found)
        counts[lang, source].update(found)
    out = []
    kept = {lang: [t for t, n in docs[lang].items() if n >= least_docs] for lang, _, _ in rows}

    def share(own, lang):
        total = sum(own[t] for t in kept[lang])
        return {t: 1 + 10**9 * (own[t] + prior) // (total + prior * len(kept[lang])) for t in kept[lang]}

    for lang, source in counts:
        p = share(counts[lang, source], lang)
        pairs = []
        for other_lang, other in counts:
            if other_lang == lang and other != source:
                q = share(counts[lang, other], lang)
                pairs.append((-sum(abs(p[t] - q[t]) for t in p), other.encode(), other))
        q = share(lang_counts[lang], lang)
        excess = [(q[t] - p[t], t.encode(), t) for t in p if counts[lang, source][t] and p[t] > q[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(excess)[:top_terms])):
            out += [(lang, source, part, item, -value, k + 1) for k, (value, _, item) in enumerate(found)]
    return sorted(out)


def made_rows(seed, count, sources=7):
    random.seed(seed)
    words = ["Alpha", "beta", "GAMMA", "délta", "Épsilon", "日本", "a1b", "x_y", "z[q", "ζ", "\U0001f600", "don't", *(f"w{chr(97 + k)}" for k in range(20))]
    return [
        (k, " ".join(random.choice(words) for _ in range(random.randrange(12))), random.choice(["en", "de", None]), random.choice([None, *map(str, range(sources))]))
        for k in range(count)
    ]


def audited(spark, rows, **options):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("term", F.lit("t")).withColumn("n", F.lit(2)).withColumn("kinds", F.lit("k"))
    return sorted(tuple(r) for r in audit_sources(docs, **options).collect())


@pytest.mark.parametrize(("groups_a_block", "terms_a_block"), [(64, 2048), (2, 3), (1, 1)])
def test_equals_plain(spark, groups_a_block, terms_a_block):
    rows = made_rows(1, 200)
    got = audited(spark, rows, least_docs=5, top_terms=4, groups_a_block=groups_a_block, terms_a_block=terms_a_block)
    assert got == plain(rows, 5, 4) and got


def test_groups_without_terms_and_langs_without_kept_terms(spark):
    rows = [(1, "a a b", "en", "x"), (2, "a c", "en", "y"), (3, None, "en", "z"), (4, "", "en", "w"), (5, "12 3", "en", "w"), (6, "q", "fr", "x"), (7, None, "fr", None), (8, "u", "it", "only")]
    rows += [rows[0], rows[0]]
    got = audited(spark, rows, least_docs=2, groups_a_block=2, terms_a_block=1)
    assert got == plain(rows, 2)
    assert [r[4] for r in got if r[0] == "fr"] == [0, 0] and not [r for r in got if r[0] == "it"]


def test_long_texts_are_counted_whole(spark):
    long = "Ab " * 500_000 + "ÉE"
    assert Counter(terms(long.encode())) == {b"ab": 500_000, "Ée".encode(): 1}
    rows = [(1, long, "en", "x"), (2, "ab cd", "en", "y")]
    assert audited(spark, rows, least_docs=1) == plain(rows, 1)


def test_counts_beyond_a_long_product_stay_exact(spark):
    from talkloom.llm.divergence import share

    n, total, kinds = 9 * 10**15 + 7, 10**18 + 1, 10**6
    frame = spark.createDataFrame([(n, total, kinds)], "n long, total long, kinds long")
    assert frame.select(share("n", "total", "kinds")).first()[0] == 1 + 10**9 * (n + 5) // (total + 5 * kinds)


def test_no_rows(spark):
    assert audited(spark, [(1, "a", "en", "x")][:0] or [(None, None, None, None)]) == []
    empty = spark.createDataFrame([], SCHEMA)
    assert audit_sources(empty).collect() == []
