"""Evaluation texts leaking into training text.

A word is a longest run of Unicode letters and decimal digits; case is ignored
(Unicode case folding, word by word). A document leaks an item if it has at
least `words` consecutive words that are consecutive in the item's prompt.

One Aho-Corasick automaton holds every window of `words` words of the items' texts
(prompts, on request answers). Each distinct word of the items is one letter of
the automaton's alphabet, so a text is scanned once as a string of such letters,
and every hit's word numbers map back to offsets in the original.

`wide` spans (the query of passages) find more: texts are normalised (NFKC, so
composed and decomposed letters and full-width forms agree), a script without
blanks between words (Han, Kana, Thai and their like) counts every two letters as
one word, and the answers of the items are looked for beside their prompts. An
offset always points into the text as it stands.

The documents are one narrow map and are read once, however many items there
are; only the found pairs move. The windows of the items are the broadcast side:
held-out sets are small and do not grow with the corpus. Their size is checked;
beyond ITEM_BYTES, or LETTERS distinct words, the windows are not broadcast but met by hash: a window of a
document's words is a row, joined with the items' windows in a shuffle, which is
exact too (`windows_joined`); windows that follow each other are then put together
to the same passages (`_passages`). The size decides the way, never the result.
A sieve of fixed size, which every window of an item passes, keeps most others out
of the shuffle.

A passage of an item is a longest run of words of a text whose every window is a
window of the item.

Defined results: NULL and empty texts and prompts, and prompts of fewer than
`words` words, give no case; a passage shared by items is a case of each; a
passage repeated in a text, or a repeated row, gives its pair once (pairs) or
each place (spans); other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORDS = 12
#: Bytes of item texts that one automaton may hold; a byte of text takes some hundred bytes of automaton.
ITEM_BYTES = 8 << 20
#: Windows that a worker holds as rows before they go to the join.
WINDOW_ROWS = 1 << 16
#: Bits of the sieve of the items' windows, a power of two; a fuller sieve lets more other windows through to the join, which drops them.
SIEVE_BITS = 1 << 27
#: Words whose hashes a worker remembers.
KNOWN_WORDS = 1 << 18
_FIRST_LETTER = 0x10000
#: Distinct words that the automaton's alphabet has letters for.
LETTERS = 0x110000 - _FIRST_LETTER
_PLAIN = re.compile(r"[a-z0-9]+").findall
_ANY = regex.compile(r"[\p{L}\p{Nd}]+")
_JOINED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]+")
_MARKED = regex.compile(r"[\p{L}\p{Nd}][\p{L}\p{M}\p{Nd}]*")


def words_of(text: str) -> list[str]:
    """The words of a text, case folded."""
    if text.isascii():
        return _PLAIN(text.lower())
    return [w.casefold() for w in _ANY.findall(text)]


def word_places(text: str) -> list[tuple[int, int]]:
    """Offsets of each word in the original text."""
    return [m.span() for m in _ANY.finditer(text)]


def _normalised(text: str) -> tuple[str, list[int] | None]:
    """NFKC of a text and, if that moved anything, the original offset of each of
    its characters and of its end. A letter and the marks behind it are
    normalised together."""
    if unicodedata.is_normalized("NFKC", text):
        return text, None
    out, at = [], []
    for m in regex.finditer(r"\X", text):
        part = unicodedata.normalize("NFKC", m.group())
        out.append(part)
        at += [m.start()] * len(part)
    return "".join(out), [*at, len(text)]


def wide_words(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Words of the normalised text and their offsets in the original: runs of
    letters with their marks; of scripts without blanks every two letters."""
    if text.isascii():
        return _PLAIN(text.lower()), [m.span() for m in _ANY.finditer(text)]
    plain, at = _normalised(text)
    words, places = [], []
    for m in _MARKED.finditer(plain):
        start = m.start()
        for piece in _pieces(m.group()):
            for i, w in piece:
                words.append(w.casefold())
                places.append((start + i, start + i + len(w)))
    if at is not None:
        ends = [*at[1:], at[-1]]
        # a character may come from several: its end is where the next original one begins
        places = [(at[a], next((ends[k] for k in range(b - 1, len(ends)) if ends[k] > at[b - 1]), at[-1])) for a, b in places]
    return words, places


def _pieces(run: str) -> Iterator[list[tuple[int, str]]]:
    end = 0
    for m in _JOINED.finditer(run):
        if m.start() > end:
            yield [(end, run[end : m.start()])]
        w = m.group()
        yield [(m.start() + i, w[i : i + 2]) for i in range(max(1, len(w) - 1))]
        end = m.end()
    if end < len(run):
        yield [(end, run[end:])]


class _Letters(dict):
    """Word to letter; a word of no item is a letter of no window."""

    def __missing__(self, word: str) -> str:
        return "\0"


class Scanner:
    """The automaton of the items: [(item_id, [words of a text, ...])]."""

    def __init__(self, items: list[tuple[int, list[list[str]]]], words: int, wide: bool = False):
        self.words, self.wide, self.letters = words, wide, _Letters()
        windows: dict[str, list[int]] = {}
        for item, texts in items:
            for ws in texts:
                for w in ws:
                    if w not in self.letters:
                        self.letters[w] = chr(_FIRST_LETTER + len(self.letters))
                line = "".join(map(self.letters.__getitem__, ws))
                for i in range(len(line) - words + 1):
                    ids = windows.setdefault(line[i : i + words], [])
                    if not ids or ids[-1] != item:
                        ids.append(item)
        self.automaton = ahocorasick.Automaton()
        for window, ids in windows.items():
            self.automaton.add_word(window, tuple(ids))
        self.some = bool(windows)
        if self.some:
            self.automaton.make_automaton()
        self.may_hold = re.compile("[^\0]{%d}" % words).search

    def _hits(self, ws: list[str]) -> Iterator[tuple[int, int]]:
        line = "".join(map(self.letters.__getitem__, ws))
        if self.may_hold(line):
            for end, ids in self.automaton.iter(line):
                for item in ids:
                    yield item, end - self.words + 1

    def hits(self, text: str) -> Iterator[tuple[int, int]]:
        """(item_id, number of the window's first word) of every hit."""
        if self.some and text:
            yield from self._hits(wide_words(text)[0] if self.wide else words_of(text))

    def spans(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, words) of each longest leaked passage, with
        offsets in the original text."""
        if not self.some or not text:
            return []
        ws, at = wide_words(text) if self.wide else (words_of(text), None)
        runs: dict[int, list[list[int]]] = {}
        for item, first in self._hits(ws):
            own = runs.setdefault(item, [])
            if own and own[-1][1] == first + self.words - 2:
                own[-1][1] = first + self.words - 1
            elif not own or own[-1][1] < first + self.words - 1:
                own.append([first, first + self.words - 1])
        if not runs:
            return []
        at = at if at is not None else word_places(text)
        return sorted((item, at[a][0], at[b][1], b - a + 1) for item, own in runs.items() for a, b in own)


_scanners: dict[tuple, Scanner] = {}


def _kernel(shared, key: tuple, words: int, spans: bool, wide: bool):
    def run(batches):
        if key not in _scanners:
            _scanners.clear()
            _scanners[key] = Scanner(shared.value, words, wide)
        s = _scanners[key]
        for b in batches:
            rows = []
            for i, text in enumerate(b.column(1)):
                t = text.as_py()
                if t:
                    rows += [(i, *x) for x in s.spans(t)] if spans else [(i, item) for item in dict.fromkeys(item for item, _ in s.hits(t))]
            if rows:
                docs = b.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                rest = [pa.array([r[k] for r in rows], pa.int64()) for k in range(1, len(rows[0]))]
                yield pa.RecordBatch.from_arrays([docs, *rest], ["doc_id", "item_id", "start", "end", "n_words"][: 1 + len(rest)])

    return run


def _item_words(items: DataFrame, texts: list[str], words: int, wide: bool) -> list:
    split = (lambda t: wide_words(t)[0]) if wide else words_of
    out = []
    for r in items.select("item_id", *texts).where("item_id is not null").collect():
        own = [ws for t in texts if r[t] and len(ws := split(r[t])) >= words]
        if own:
            out.append((r["item_id"], own))
    return out


def _size(items: DataFrame, texts: list[str]) -> int:
    return items.agg(F.sum(sum((F.coalesce(F.octet_length(t), F.lit(0)) for t in texts), F.lit(0)))).first()[0] or 0


def _to_broadcast(items: DataFrame, texts: list[str], words: int, wide: bool, limit: int) -> list | None:
    """The items' words, if one automaton may hold them."""
    if _size(items, texts) > limit:
        return None
    own = _item_words(items, texts, words, wide)
    return own if len({w for _, many in own for ws in many for w in ws}) <= LETTERS else None


def _scan(documents: DataFrame, own: list, words: int, spans: bool, wide: bool) -> DataFrame:
    more = ["start", "end", "n_words"] if spans else []
    schema = T.StructType([documents.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ["item_id", *more]]])
    shared = documents.sparkSession.sparkContext.broadcast(own)
    key = (shared._jbroadcast.id() if shared._jbroadcast else id(shared), words, wide)
    return documents.select("doc_id", "text").mapInArrow(_kernel(shared, key, words, spans, wide), schema)


def _digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


class _Known(dict):
    """Word to 64 bits of hash."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def _marks(ws: list[str], words: int, known: _Known) -> np.ndarray:
    """64 bits of hash of every window, a polynomial of those of its words."""
    h = np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))
    out = np.zeros(max(0, len(ws) - words + 1), np.uint64)
    for k in range(words if len(out) else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)]
    return out


def _passing(marks: np.ndarray, sieve: np.ndarray) -> np.ndarray:
    """Numbers of the windows that the sieve lets through."""
    both = np.ones(len(marks), np.uint64)
    for part in (marks, marks >> np.uint64(32)):
        at = part & np.uint64(64 * len(sieve) - 1)
        both &= sieve[at >> np.uint64(6)] >> (at & np.uint64(63))
    return np.flatnonzero(both)


def _sieve(marks: DataFrame) -> np.ndarray:
    """Two bits set for every mark, joined by the engine into words of 64 bits."""
    at = marks.select(F.explode(F.array(F.col("mark"), F.shiftrightunsigned("mark", 32))).alias("at")).select(F.col("at").bitwiseAND(F.lit(SIEVE_BITS - 1)).alias("at"))
    t = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(SIEVE_BITS >> 6, np.uint64)
    out[t["word"].to_numpy()] = t["bits"].to_numpy().view(np.uint64)
    return out


def _window_batch(b: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
    place, row, key, *rest = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [b.column(0).take(pa.array(place, pa.int64())), pa.array(row, pa.binary()), pa.array(key, pa.binary()), *[pa.array(x, pa.int64()) for x in rest]], ["id", "row", "key", "mark", "first", "start", "end"])


def _window_kernel(words: int, wide: bool, texts: int, sieve=None):
    def run(batches):
        known = _Known()
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                for c in range(1, texts + 1):
                    t = b.column(c)[i].as_py()
                    if not t:
                        continue
                    ws, at = wide_words(t) if wide else (words_of(t), None)
                    marks = _marks(ws, words, known)
                    passing = (_passing(marks, sieve.value) if sieve else np.arange(len(marks))).tolist()
                    if not passing:
                        continue
                    at = at if at is not None else word_places(t)
                    row, marks = _digest(t), marks.view(np.int64)
                    for k in passing:
                        rows.append((i, row, _digest("\0".join(ws[k : k + words])), int(marks[k]), k, at[k][0], at[k + words - 1][1]))
                        if len(rows) >= WINDOW_ROWS:
                            yield _window_batch(b, rows)
                            rows = []
            if rows:
                yield _window_batch(b, rows)

    return run


def _windows(df: DataFrame, id_: str, texts: list[str], words: int, wide: bool, sieve=None) -> DataFrame:
    schema = T.StructType([T.StructField("id", df.schema[id_].dataType), *[T.StructField(c, T.BinaryType()) for c in ("row", "key")], *[T.StructField(c, T.LongType()) for c in ("mark", "first", "start", "end")]])
    return df.select(id_, *texts).mapInArrow(_window_kernel(words, wide, len(texts), sieve), schema)


def windows_joined(documents: DataFrame, items: DataFrame, texts: list[str], words: int, wide: bool = False) -> DataFrame:
    """The same windows, found by a join on 16 bytes of hash: doc_id, row (16 bytes
    of hash of the text), item_id, first, start and end of every hit. The items'
    windows are made distinct before, and the engine splits a window that a third of
    all texts share."""
    met = _windows(items.where("item_id is not null"), "item_id", texts, words, wide)
    sieve = documents.sparkSession.sparkContext.broadcast(_sieve(met.select("mark")))
    own = met.select("key", F.col("id").cast("long").alias("item_id")).distinct()
    a, b = _windows(documents, "doc_id", ["text"], words, wide, sieve).alias("a"), own.alias("b").hint("merge")
    return a.join(b, F.col("a.key") == F.col("b.key")).select(F.col("a.id").alias("doc_id"), "a.row", "b.item_id", "a.first", "a.start", "a.end")


def _passages(hits: DataFrame, words: int) -> DataFrame:
    """The longest passages of hits: windows whose numbers follow each other are one.
    Documents of one doc_id are told apart by their text; of equal rows each window
    is there as often, and so is the passage."""
    text = ["doc_id", "row", "item_id"]
    once = hits.groupBy(*text, "first").agg(F.min("start").alias("start"), F.min("end").alias("end"), F.count("*").alias("times"))
    runs = once.withColumn("run", F.col("first") - F.row_number().over(Window.partitionBy(*text).orderBy("first")))
    whole = runs.groupBy(*text, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.count("*") + F.lit(words - 1)).alias("n_words"), F.min("times").alias("times"))
    return whole.select("*", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy")).select("doc_id", "item_id", "start", "end", "n_words")


def leaked_items(documents: DataFrame, items: DataFrame, words: int = WORDS, limit: int = ITEM_BYTES) -> DataFrame:
    """doc_id, item_id of every document and item it leaks, once each."""
    own = _to_broadcast(items, ["prompt"], words, False, limit)
    if own is None:
        return windows_joined(documents, items, ["prompt"], words).select("doc_id", "item_id").distinct()
    return _scan(documents, own, words, False, False).distinct()


def leaked_spans(documents: DataFrame, items: DataFrame, words: int = WORDS, limit: int = ITEM_BYTES) -> DataFrame:
    """Every leaked passage of a prompt or an answer, read wide: doc_id, item_id,
    start, end (offsets in the original text, end excluded) and n_words."""
    texts = ["prompt", "answer"]
    own = _to_broadcast(items, texts, words, True, limit)
    if own is None:
        return _passages(windows_joined(documents, items, texts, words, True), words)
    return _scan(documents, own, words, True, True)
