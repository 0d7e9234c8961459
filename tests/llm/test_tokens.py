"""Token counts against the tokenizers library itself."""

import random

import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    from hirefold.llm.tokens import Vocabulary
    return Vocabulary(PATH)


def odd_texts():
    rnd = random.Random(1)
    letters = [c for c in (chr(rnd.randrange(0x110000)) for _ in range(2500)) if not 0xD800 <= ord(c) < 0xE000]
    letters += [chr(c) for c in (0x558, 0xC5C, 0x208F, 0x3FC3F)] + list(" \t\n\r\x0b\x0c\x1c\x85\xa0'strelvmd<|endoftext|>09aZé日") * 40
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(200))) for _ in range(600)]
    return [*texts, *(t + "<|endoftext|>" + t for t in texts[:50]), "", " ", "\n \n", "<|endoftext|>", "<|endoftext|", "I'LL we'll"]


def test_whole_tokens_are_proven(vocabulary, library):
    whole = set(vocabulary.whole)
    assert len(whole) > 49_000
    encoded = library.encode_batch(sorted(whole), add_special_tokens=False)
    assert all(len(e.ids) == 1 for e in encoded)


def test_counts_of_odd_texts(vocabulary, library):
    count, texts = vocabulary.counter(), odd_texts()
    assert [count(t) for t in texts] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("text", ["a" * 60_000, "ab" * 30_000, "!" * 5_000, " " * 70_001, "\n" * 999 + "x",
                                  "".join(random.Random(2).choice("abcdef") for _ in range(50_000)), "w é " * 300_000])
def test_counts_of_very_long_texts_and_words(vocabulary, library, text):
    assert vocabulary.counter()(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_lists_and_heap_merge_alike(vocabulary):
    rnd = random.Random(4)
    for _ in range(500):
        data = bytes(rnd.choice(b"abcaeeiost hn\xc3\xa9") for _ in range(rnd.randrange(1, 90)))
        assert vocabulary.merges._short(data) == vocabulary.merges._long(data)


def test_little_memory_forgets_but_counts_alike(vocabulary, library, monkeypatch):
    from hirefold.llm import tokens
    monkeypatch.setattr(tokens, "REMEMBER", 3)
    text = " ".join(f"zq{i}xw" for i in range(50)) * 2
    assert vocabulary.counter()(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_count_tokens(spark, library):
    from hirefold.llm.tokens import count_tokens
    rows = [(1, "Hello world", "x"), (1, "Hello world", "x"), (2, None, "x"), (None, "Éa", None), (3, "", "x"), (4, "word " * 1025, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").withColumn("over_limit", F.lit("x")).repartition(2)
    got = sorted(map(tuple, count_tokens(df, PATH).collect()), key=str)
    want = []
    for i, t, _ in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 1024))
    assert got == sorted(want, key=str)
    assert count_tokens(df.limit(0), PATH).collect() == []


def test_whole_table(spark, library):
    from hirefold.llm import queries as Q
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {i: len(e.ids) for i, e in zip(texts, library.encode_batch(list(texts.values()), add_special_tokens=False), strict=True)}
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in Q.op11_tokens(spark, sf).collect()}
    assert got == {i: (len(texts[i].encode()), n) for i, n in want.items()}


def test_other_kinds_of_vocabulary_are_refused():
    from hirefold.llm.tokens import Vocabulary
    with pytest.raises(ValueError):
        Vocabulary(P.path("word_bpe_49k.json"))
