import random

import pytest
from tokenizers import Tokenizer

from gapfold.llm import tokens

PATH = tokens.DEFAULT_PATH


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, "rb") as f:
        return tokens.Encoder(f.read())


@pytest.fixture(scope="module")
def public():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


TEXTS = ["", " ", "Hello  world\n\n\t x'll don't", "naïve Straße 東京 ٣٤ ½ 🙂​", "<|endoftext|> a<|endoftext|>", "\r\n\r\n  end ", "aaaaaaaaaaaaaaaaaaaaaaaa", "\x00\x01\x7f\x80", "é" * 9]


def test_same_ids(encoder, public):
    for t in TEXTS:
        assert encoder.encode(t) == public(t), t


def test_random_texts(encoder, public):
    rng = random.Random(9)
    alphabet = "abcdetheing   \n\t'.,;()_-0123ÄßжЖ中語🙂́"
    for _ in range(400):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 120)))
        assert encoder.encode(t) == public(t), t


def test_very_long_pre_tokens(encoder, public):
    for t in ("a" * 30_000, "the" * 20_000, " " * 20_000 + "x", "=-" * 15_000, "é" * 9_000):
        assert encoder.encode(t) == public(t)


def test_cache_may_be_emptied(encoder, public, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 3)
    t = "one two three four five six seven one two three"
    assert encoder.encode(t) == public(t) and len(encoder) <= 3 + 1


def test_rank_queue():
    rng = random.Random(3)
    q, held = tokens.RankQueue(50_000), {}
    for _ in range(4000):
        if rng.random() < 0.6 or not held:
            r, p = rng.randrange(50_000) if rng.random() < 0.7 else rng.randrange(5), rng.randrange(1000)
            q.push(r, p)
            held.setdefault(r, []).append(p)
        else:
            r = min(held)
            assert q.pop() == (r, sorted(held.pop(r)))
    while held:
        r = min(held)
        assert q.pop() == (r, sorted(held.pop(r)))
    assert q.pop() is None
    with pytest.raises(ValueError):
        tokens.RankQueue(64**3 + 1)


def test_corpus(spark, public, monkeypatch):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, None), (101, "dup"), (101, "dup"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "'x' as lang")
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.ids) for r in tokens.encode_corpus(df).collect())
    assert got == sorted((-1 if i is None else i, public(t) if t else []) for i, t in rows)
    assert tokens.encode_corpus(df.limit(0)).count() == 0
    assert tokens.encode_corpus(df).schema["ids"].dataType.simpleString() == "array<int>"


def test_vocabulary_size_is_checked(spark, monkeypatch):
    monkeypatch.setattr(tokens, "MAX_VOCABULARY_BYTES", 1000)
    with pytest.raises(ValueError):
        tokens.encode_corpus(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
