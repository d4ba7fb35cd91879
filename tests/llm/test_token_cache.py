"""Token counts: the library's own, by way of the cache, and only misses are encoded."""

import public_tokenizers
import pytest
from odd import ODD_ROWS
from parapet.llm import token_cache
from tokenizers import Tokenizer

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def direct(texts, path=BYTES):
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        return [len(SentencePieceProcessor(model_file=path).encode(t)) for t in texts]
    tokenizer = Tokenizer.from_file(path)
    return [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def want(rows, path=BYTES):
    texts = [r[1] or "" for r in rows]
    return sorted(((r[0], len(t.encode()), n, n > 512) for r, t, n in zip(rows, texts, direct(texts, path))), key=repr)


def got(df, cache, path=BYTES, **more):
    return sorted((tuple(r) for r in token_cache.count_tokens(df, path, str(cache), **more).collect()), key=repr)


ODD = [*ODD_ROWS, (60, "a<|endoftext|>b <|endoftext|>", None, None), (61, "<|ENDOFTEXT|>", None, None), (62, "\x1c a b c  d\r\n\r\n e's we'll", None, None), (63, "nul\x00 byte", None, None)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_odd_rows(documents, tmp_path, name):
    path = public_tokenizers.path(name)
    assert got(documents(ODD, clashes=True), tmp_path / "cache", path) == want(ODD, path)
    assert got(documents([]), tmp_path / "cache", path) == []


def test_given_texts(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(docs, tmp_path / "cache") == want(rows)


def test_empty_table_with_empty_cache(documents, tmp_path):
    assert got(documents([]), tmp_path / "cache") == []


@pytest.mark.parametrize("few", [0, 100])
def test_only_distinct_misses_are_encoded(spark, documents, tmp_path, monkeypatch, few):
    """Either side of the broadcast check."""
    monkeypatch.setattr(token_cache, "FEW_MISSES", few)
    cache, version = f"{tmp_path}/cache", token_cache.version_of(BYTES)
    first, more = [(i, f"text {i % 7}") for i in range(50)], [(i, f"text {i % 9}") for i in range(30)]
    assert got(documents(first), cache) == want(first)
    folder = spark.read.parquet(f"{cache}/version={version}")
    assert folder.count() == 7
    assert got(documents(more), cache) == want(more)
    assert spark.read.parquet(f"{cache}/version={version}").count() == 9
    # All hits: nothing is added, and stored counts are what is returned.
    assert got(documents(first), cache) == want(first)
    assert spark.read.parquet(f"{cache}/version={version}").count() == 9


def test_stored_counts_are_used_and_read_once(spark, documents, tmp_path):
    cache, version = f"{tmp_path}/cache", token_cache.version_of(BYTES)
    rows = [(1, "known"), (2, "known"), (3, "new")]
    for _ in range(2):
        spark.createDataFrame([("known",)], "t string").selectExpr("unhex(sha2(t, 256)) AS digest", "777L AS n_tokens").write.mode("append").parquet(f"{cache}/version={version}")
    assert got(documents(rows), cache) == [(1, 5, 777, True), (2, 5, 777, True), (3, 3, 1, False)]
    assert token_cache.stored(spark, cache, token_cache.version_of(public_tokenizers.path("word_bpe_49k.json"))) is None


def test_normalised_content(documents, tmp_path):
    """Lower-casing is invisible to the word tokenizer, so texts that differ in case share an entry."""
    from pyspark.sql import functions as F

    path, rows = public_tokenizers.path("word_bpe_49k.json"), [(1, "Some Words"), (2, "some words"), (3, None)]
    lower = lambda c: F.lower(F.coalesce(c, F.lit("")))
    df = documents(rows)
    assert got(df, tmp_path / "cache", path, normalise=lower) == want(rows, path)
    assert token_cache.stored(df.sparkSession, f"{tmp_path}/cache", token_cache.version_of(path)).count() == 2


def test_pieces():
    """Cut texts have the counts of whole ones, whatever stands at the cuts."""
    counter = token_cache.TokenCounter(BYTES)
    texts = ["word " * 400, "a  b " * 300, "it's we'll 12 345 x\n" * 90, "东京 大阪 " * 200, "東京" * 500, "x" * 3000, " \n " * 500, "end<|endoftext|> of it " * 60, "a_b c_ d ²3 é" * 99]
    for size in (1, 2, 7, 64):
        assert all("".join(counter.pieces(t, size)) == t for t in texts)
        assert counter.counts(texts, size) == direct(texts)
    assert len(list(counter.pieces(texts[0], 7))) > 100


@pytest.mark.parametrize("most", [0, 3, 1000])
def test_kept_words(monkeypatch, most):
    """Counts are those of whole texts, whatever white space there is and however few words are kept."""
    monkeypatch.setattr(token_cache, "WORDS", most)
    counter = token_cache.TokenCounter(BYTES)
    assert all("".join(counter.known(t)[1]) == t for t in ["\u00a0a" * 100_000, "a\n" + " \n" * 100_000, "\x1c \x1c" * 100_000])
    blanks = [chr(c) for c in range(0x3001) if chr(c).isspace()] + ["\u200b", "\u180e", "\ufeff", "\u00e9"]
    texts = [form.format(c) for c in blanks for form in ("a{0}b", "!{0}{0} {0}b.", "it's {0} we{0}'ll\n{0}x", "{0}  {0}\t", "a{0}<|endoftext|> {0}<|endoftext|>\n")]
    texts += ["", " ", "x" * 500 + " y", "<|endoftext|> a <|endof text|>", *[r[1] or "" for r in ODD]]
    for size in (5, token_cache.PIECE):
        assert counter.counts(texts, size) == counter.counts(texts, size) == direct(texts)
    assert len(counter.words) <= most
    assert all(len(w) <= token_cache.WORD for w in counter.words)


def test_known_words_are_not_encoded_again(monkeypatch):
    counter = token_cache.TokenCounter(BYTES)
    given, encode = [], counter.encode
    monkeypatch.setattr(counter, "encode", lambda texts: given.extend(texts) or encode(texts))
    texts = ["the same few words, of it\n" * k for k in range(1, 60)]
    assert counter.counts(texts) == direct(texts)
    assert sum(map(len, given)) < len(texts[-1])
    # A full worker encodes what it doesn't know as one string.
    monkeypatch.setattr(token_cache, "WORDS", len(counter.words))
    given.clear()
    text = "new ones beside\nthe same few words, of it"
    assert counter.counts([text]) == direct([text])
    assert given == ["new ones beside"]
