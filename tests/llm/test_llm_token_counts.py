import random

import pytest
from pyspark.sql import functions as F

from talkloom.llm import token_counts
from talkloom.llm.token_counts import count_tokens, stable_places

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
SPECIALS = ("<|startoftext|>", "<|endoftext|>")


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: len(tokenizer.encode(text or "", add_special_tokens=False).ids)


def odd_text(seed, size):
    random.seed(seed)
    parts = [
        "it's", "we'll", "'s't", "!'s", "''", "don't!'re", "x1y22", "...", "a.b,c", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof",
        "é", "́", "한", "한국어", "日本語。漢字", "İstanbul", "ǅ", "ſ", "ῼ", "👩‍👩‍👧", "​", " ", "　", "\n\n", "\t", " ", " ", " ",
        "word", "Wörter", "12345", "٣٤", "ⅷ", "ª", "क़", "ﬁ", "\u0000", "ẛ̣",
    ]
    return "".join(random.choice(parts) for _ in range(size))


def test_places_are_cuts_in_any_context(whole):
    for seed in range(60):
        text = odd_text(seed, 40)
        for place in stable_places(text, SPECIALS):
            assert whole(text[:place]) + whole(text[place:]) == whole(text), (seed, place)


def test_specials_and_ends_have_no_place():
    text = "a" * 20 + " <|endoftext|> " + "b " * 20
    places = set(stable_places(text, SPECIALS).tolist())
    start = text.index("<|")
    assert not places & set(range(start + 1, start + 13)) and start in places
    assert min(places) >= 15 and max(places) <= len(text) - 15


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 48), (200, 40), (500, 100)])
def test_chunks_count_as_the_whole(spark, docs_of, whole, chunk, overlap):
    texts = [odd_text(seed, size) for seed, size in enumerate([0, 1, 30, 200, 900, 900, 2500])]
    texts += [None, "", "x" * 3000, "ab " * 700, "漢" * 2000, "!" * 1500 + "'s" * 500, "<|endoftext|>" * 150, "á" * 900, " " * 2000, "1" * 999]
    docs = docs_of([*enumerate(texts), (0, texts[4]), (None, texts[5]), (None, texts[5])])
    docs = docs.withColumn("row", F.lit(1)).withColumn("chunk", F.lit("x")).withColumn("n_tokens", F.lit(3))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(docs, PATH, chunk=chunk, overlap=overlap, limit=700).collect())
    rows = [*enumerate(texts), (0, texts[4]), (-1, texts[5]), (-1, texts[5])]
    assert got == sorted((k, len((t or "").encode()), whole(t), whole(t) > 700) for k, t in rows)


def test_an_unbroken_run_widens_until_it_is_whole(spark, docs_of, whole, monkeypatch):
    cuts = []
    plain = token_counts._cut
    monkeypatch.setattr(token_counts, "_cut", lambda chunk, overlap: cuts.append(chunk) or plain(chunk, overlap))
    text = "abc" * 1000 + " end"
    assert count_tokens(docs_of([(1, text), (2, "ab " * 500)]), PATH, chunk=64, overlap=32).select("n_tokens").collect()
    assert cuts == [64, 512, 4096]
    rows = {r.doc_id: r.n_tokens for r in count_tokens(docs_of([(1, text), (2, "ab " * 500)]), PATH, chunk=64, overlap=32).collect()}
    assert rows == {1: whole(text), 2: 500}


def test_only_failing_texts_are_cut_again(spark, docs_of):
    long = docs_of([(1, "ab " * 500), (2, "z" * 900)]).selectExpr("doc_id as row", "doc_id", "cast(length(text) as long) as n_bytes", "text")
    pieces = long.mapInArrow(token_counts._cut(64, 32), token_counts.CHUNKS)
    edges = pieces.mapInArrow(token_counts._encoded(PATH, 64, 32), token_counts.EDGES)
    rows = {r.doc_id: (r.n_tokens, r.failed) for r in token_counts._spliced(edges).collect()}
    assert rows[1] == (500, 0) and rows[2][1] > 0


def test_other_files_are_counted_whole(spark, docs_of):
    import sentencepiece
    from tokenizers import Tokenizer

    texts = ["Some words.", "", None, "käse " * 300, "<s> </s> <|endoftext|>"]
    docs = docs_of(list(enumerate(texts)))
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r.n_tokens for r in count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), chunk=64, overlap=32).collect()}
    assert got == {k: len(pieces.encode(t or "")) for k, t in enumerate(texts)}
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    got = {r.doc_id: r.n_tokens for r in count_tokens(docs, path, chunk=64, overlap=32).collect()}
    assert got == {k: len(plain.encode(t or "", add_special_tokens=False).ids) for k, t in enumerate(texts)}


def test_no_rows(spark, docs_of):
    empty = docs_of([(1, "x")]).where("false")
    assert count_tokens(empty, PATH).collect() == []
    assert count_tokens(empty, PATH).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def test_known_runs_are_not_encoded_again(monkeypatch):
    """Counts of the library, which sees each run of a text once."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from talkloom.llm import token_files
    from talkloom.llm.token_counts import Counter

    path = public_tokenizers.path("word_bpe_49k.json")
    whole, counter = Tokenizer.from_file(path), Counter(path)
    texts = ["Some words, some WORDS; don't 12 ćevapi x", "", " \t\n", "a<|endoftext|>b é 가 日本語 😀", "x\x0by\x1cz q\x85r"]
    assert counter.counts(texts) == [len(whole.encode(t, add_special_tokens=False).ids) for t in texts]
    seen, missing = [], token_files.ChunkIds.__missing__
    monkeypatch.setattr(token_files.ChunkIds, "__missing__", lambda self, run: seen.append(run) or missing(self, run))
    assert counter.counts(["zqxjv zqxjv", "zqxjv"]) == [len(whole.encode(t, add_special_tokens=False).ids) for t in ("zqxjv zqxjv", "zqxjv")]
    assert seen == [b"zqxjv"]
