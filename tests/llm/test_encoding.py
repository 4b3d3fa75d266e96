import pytest

from plumbline.llm import encoding

pytest.importorskip("tokenizers")
TEXTS = [None, "", " ", "Hello world", "naïve café 👩‍💻 日本語", "<|endoftext|> plain", "a" * 5000, "x\n" * 3000, "Почему?", "Hello world"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").selectExpr("*", "1 as ids", "'y' as __source").repartition(3)


@pytest.fixture(scope="module")
def path():
    return encoding.vocabulary_path()


def test_ids_equal_another_library(docs, path):
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r.ids for r in encoding.encode(docs, path).collect()}
    assert got == {k: other.encode_ordinary(t or "") for k, t in enumerate(TEXTS)}
    counts = {r.doc_id: r.tokens for r in encoding.token_counts(docs, path, "ids").collect()}
    assert counts == {k: len(v) for k, v in got.items()}


def test_round_trip(docs, path):
    got = {r.doc_id: r.text for r in encoding.decoded(encoding.encode(docs, path), path).collect()}
    assert got == {k: t or "" for k, t in enumerate(TEXTS)}


def test_split_characters(path):
    ids = encoding.tokenizer(path).encode("日本語", add_special_tokens=False).ids
    assert encoding.decode(ids, path) == "日本語"
    assert "�" in encoding.decode(ids[:1], path) or len(ids) == 1


def test_offsets(docs, path):
    for r in encoding.offsets(docs, path).collect():
        text = TEXTS[r.doc_id] or ""
        assert len(r.starts) == len(r.ends) and all(a < b for a, b in zip(r.starts, r.ends))
        if text.isascii():
            assert "".join(text[a:b] for a, b in zip(r.starts, r.ends)) == text
        elif r.ends:
            assert r.starts[0] == 0 and r.ends[-1] == len(text)


def test_empty(docs, path):
    assert encoding.encode(docs.filter("false"), path).collect() == []
