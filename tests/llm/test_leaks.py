import random
from collections import Counter

import pyarrow as pa
import regex

from gapfold.llm import leaks

WORDS = ["alpha", "beta", "gamma", "delta", "straße", "ΣΊΣΥΦΟΣ", "7", "x1"]


def brute(text, prompt, n):
    w = lambda t: [x.casefold() for x in regex.findall(r"[\p{L}\p{Nd}]+", t)]
    a, b = w(text), w(prompt)
    windows = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)}
    return any(tuple(a[i : i + n]) in windows for i in range(len(a) - n + 1))


def test_against_brute_force(spark):
    rng = random.Random(4)
    sep = [" ", ", ", "\n+", "_", " – ", "­", "́ ", "("]
    say = lambda n: "".join((rng.choice(WORDS).upper() if rng.random() < 0.3 else rng.choice(WORDS)) + rng.choice(sep) for _ in range(n))
    docs = [(i, say(rng.randint(0, 40))) for i in range(80)] + [(900, None), (901, ""), (902, "   ")]
    items = [(i, say(rng.randint(3, 30)), None) for i in range(25)] + [(77, None, None), (78, "", "B"), (None, say(20), None)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "'p' as prompt", "2 as start")
    e = spark.createDataFrame(items, "item_id long, prompt string, answer string").selectExpr("*", "'t' as text", "3 as doc_id")
    want = {(i, k) for i, t in docs for k, p, _ in items if t and p and k is not None and brute(t, p, 4)}
    for limit in (leaks.ITEM_BYTES, 0):
        got = [tuple(r) for r in leaks.leaked_items(d, e, words=4, limit=limit).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want
    assert leaks.leaked_items(d.limit(0), e).count() == 0 and leaks.leaked_items(d, e.limit(0)).count() == 0
    wide = {(r.doc_id, r.item_id) for r in leaks.leaked_spans(d, e, words=4).collect()}
    assert wide == {(r.doc_id, r.item_id) for r in leaks.leaked_spans(d, e, words=4, limit=0).collect()} and wide


def test_spans_point_into_the_original():
    s = leaks.Scanner([(5, [leaks.words_of("Der Bäcker fand zehn Kisten mit Straßenbahn und Obst")])], 4)
    text = "++ noch: DER\n-BÄCKER — fand (zehn) kisten; Ende. mit STRASSENBAHN und obst"
    assert [(i, text[a:b], n) for i, a, b, n in s.spans(text)] == [(5, "DER\n-BÄCKER — fand (zehn) kisten", 5), (5, "mit STRASSENBAHN und obst", 4)]
    assert s.spans("") == [] and list(s.hits("Der Bäcker fand")) == []


def test_spans_of_answers(spark):
    d = spark.createDataFrame([(1, "one two three four")], "doc_id long, text string")
    e = spark.createDataFrame([(9, "other", "one two three four five")], "item_id long, prompt string, answer string")
    assert leaks.leaked_items(d, e, words=4).count() == 0
    assert [tuple(r) for r in leaks.leaked_spans(d, e, words=4).collect()] == [(1, 9, 0, 18, 4)]


def test_wide_words():
    nfc, nfd = "L\u2019\u00e9cole pr\u00e9f\u00e8re la for\u00eat", "L\u2019e\u0301cole pre\u0301fe\u0300re la fore\u0302t"
    a, b = leaks.wide_words(nfc), leaks.wide_words(nfd)
    assert a[0] == b[0] == ["l", "\u00e9cole", "pr\u00e9f\u00e8re", "la", "for\u00eat"]
    assert [nfd[i:j] for i, j in b[1]][1:3] == ["e\u0301cole", "pre\u0301fe\u0300re"]
    assert leaks.wide_words("\uff21\uff22\uff23 x")[0] == ["abc", "x"] and leaks.wide_words("\ufb01n")[0] == ["fin"]
    assert leaks.wide_words("\u6211\u4eec\u7684abc\u5929")[0] == ["\u6211\u4eec", "\u4eec\u7684", "abc", "\u5929"]


def test_wide_spans_find_scripts_without_blanks_and_decomposed_letters(spark):
    prompt = "\u6211\u4eec\u5728\u6cb3\u8fb9\u7684\u8001\u623f\u5b50\u91cc\u627e\u5230\u4e86\u4e00\u672c\u65e7\u4e66\uff0c\u91cc\u9762\u5199\u7740"
    french = "les \u00e9l\u00e8ves de la premi\u00e8re \u00e9cole ont tr\u00e8s bien \u00e9tudi\u00e9 cette le\u00e7on"
    import unicodedata

    d = spark.createDataFrame([(1, "x " + prompt + " y"), (2, unicodedata.normalize("NFD", "Oui, " + french + " !")), (3, "nothing")], "doc_id long, text string")
    e = spark.createDataFrame([(5, prompt, None), (6, french, None)], "item_id long, prompt string, answer string")
    got = {(r.doc_id, r.item_id): (r.start, r.end) for r in leaks.leaked_spans(d, e).collect()}
    assert set(got) == {(1, 5), (2, 6)} and got[1, 5][0] == 2
    assert got[2, 6] == (5, len(unicodedata.normalize("NFD", "Oui, " + french)))
    assert leaks.leaked_items(d, e).count() == 0  # the plain reading of a word


def test_long_text_and_repeats(spark):
    p = " ".join(f"w{i}" for i in range(12))
    d = spark.createDataFrame([(1, "z " * 400_000 + p + " q " + p), (1, p), (2, p.replace("w5", "w6"))], "doc_id long, text string")
    e = spark.createDataFrame([(1, p, ""), (2, "start " + p + " end", "")], "item_id long, prompt string, answer string")
    assert sorted(map(tuple, leaks.leaked_items(d, e).collect())) == [(1, 1), (1, 2)]


def test_passages_do_not_depend_on_the_size_of_the_items(spark):
    rng = random.Random(8)
    sep = [" ", ", ", "\n+", "_", " – ", "­", "́ ", "("]
    pool = ["alpha", "beta", "straße", "école", "ﬁn", "我们的", "7"]
    say = lambda n: "".join((rng.choice(pool).upper() if rng.random() < 0.3 else rng.choice(pool)) + rng.choice(sep) for _ in range(n))
    docs = [(i, say(rng.randint(0, 60))) for i in range(60)]
    docs += [*docs[:20], *docs[:5], *[(i, say(40)) for i in range(10)], (None, docs[7][1]), (None, docs[8][1]), (900, None), (901, "")]
    items = [(i % 20, say(rng.randint(3, 40)), rng.choice([None, "", say(20)])) for i in range(25)] + [(None, say(20), None)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).selectExpr("*", "1 as item_id", "'x' as row", "2 as start")
    e = spark.createDataFrame(items, "item_id long, prompt string, answer string").selectExpr("*", "'t' as text", "3 as doc_id")
    for words in (1, 3, 4):
        own = leaks.leaked_spans(d, e, words=words)
        met = leaks.leaked_spans(d, e, words=words, limit=0)
        want = Counter(map(tuple, own.collect()))
        assert Counter(map(tuple, met.collect())) == want and [f[:2] for f in met.dtypes] == own.dtypes
        assert max(r[4] for r in want) > words and max(want.values()) >= 3


def test_windows_of_a_long_text_go_to_the_join_in_parts(monkeypatch):
    b = pa.RecordBatch.from_arrays([pa.array([5, None, 6]), pa.array(["a b c d e f g", None, "h i j"])], ["doc_id", "text"])
    whole = [r for x in leaks._window_kernel(2, True, 1)([b]) for r in x.to_pylist()]
    monkeypatch.setattr(leaks, "WINDOW_ROWS", 3)
    parts = list(leaks._window_kernel(2, True, 1)([b]))
    assert [x.num_rows for x in parts] == [3, 3, 2] and [r for x in parts for r in x.to_pylist()] == whole
    assert [(r["id"], r["first"]) for r in whole] == [(5, 0), (5, 1), (5, 2), (5, 3), (5, 4), (5, 5), (6, 0), (6, 1)]


def test_a_sieve_keeps_every_window_of_an_item(spark, monkeypatch):
    rng = random.Random(3)
    say = lambda n: " ".join(f"w{rng.randint(0, 400)}" for _ in range(n))
    items = [(i, say(60)) for i in range(20)]
    docs = [(i, say(200) + " " + items[i % 20][1][:120]) for i in range(60)]
    e = spark.createDataFrame(items, "item_id long, prompt string").selectExpr("*", "cast(null as string) as answer")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    want = Counter(map(tuple, leaks.leaked_spans(d, e, words=4).collect()))
    sieve = lambda: spark.sparkContext.broadcast(leaks._sieve(leaks._windows(e, "item_id", ["prompt"], 4, True).select("mark")))
    every = leaks._windows(d, "doc_id", ["text"], 4, True).count()
    through = leaks._windows(d, "doc_id", ["text"], 4, True, sieve()).count()
    assert sum(r[4] - 3 for r in want) <= through < every / 5
    monkeypatch.setattr(leaks, "SIEVE_BITS", 64)  # full: all come to the join
    assert leaks._windows(d, "doc_id", ["text"], 4, True, sieve()).count() == every
    assert Counter(map(tuple, leaks.leaked_spans(d, e, words=4, limit=0).collect())) == want


def test_items_of_more_words_than_the_alphabet_has_letters(spark):
    p = " ".join(f"{i:x}" for i in range(1_050_000))
    assert len(p) < leaks.ITEM_BYTES
    d = spark.createDataFrame([(1, "see " + p[-200:] + " end"), (2, "nothing")], "doc_id long, text string")
    e = spark.createDataFrame([(7, p)], "item_id long, prompt string")
    assert [tuple(r) for r in leaks.leaked_items(d, e).collect()] == [(1, 7)]
