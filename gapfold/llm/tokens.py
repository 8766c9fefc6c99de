"""Encoding of a corpus with a public byte-level BPE tokenizer.

Texts are cut into pre-tokens by the tokenizer's pattern; each pre-token is
merged by a rank queue: a bucket per merge rank holds positions of a linked
list, a three-level bitmap over the ranks finds the next rank with two or three
find-first-set steps, and entries that no longer match are skipped as stale.
The work is linear in the pre-token's length but for sorting the positions of a
bucket, so very long pre-tokens (a megabyte of one letter) cost no more per
byte than short ones. Pre-tokens repeat, so each Python worker keeps the ids of
those seen; the table is emptied when it is full, which changes no result.

The corpus is one narrow map over (doc_id, text): no shuffle, nothing is
gathered. The vocabulary file is read on the driver and broadcast; its size is
checked against MAX_VOCABULARY_BYTES.

Defined results: NULL and empty texts give an empty list; special tokens'
strings are ordinary text; repeated documents give repeated rows; an empty
table gives no rows; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import json
from array import array
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_PATH = "/opt/tokenizers/byte_bpe_50k.json"
MAX_VOCABULARY_BYTES = 64 << 20
#: Pre-tokens a worker remembers, and the longest it remembers.
CACHE_ENTRIES = 300_000
CACHE_CHARS = 48
#: Ids of one output batch.
BATCH_IDS = 2_000_000
# Fixed value: the pre-token pattern of the byte-level tokenizers.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary:
    itself where it is visible, else the next free one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in visible else next(hidden)) for b in range(256)]


class RankQueue:
    """Positions by merge rank, lowest rank first.

    Three levels of 64-bit words: a bit of the lowest level says that a rank's
    bucket holds positions, a bit above says that a word is not zero.
    """

    def __init__(self, ranks: int):
        if ranks > 64**3:
            raise ValueError("more merge ranks than three levels of 64-bit words hold")
        words = -(-ranks // 64)
        self.low = [0] * words
        self.mid = [0] * (-(-words // 64))
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        w, m = rank >> 6, rank >> 12
        self.low[w] |= 1 << (rank & 63)
        self.mid[m] |= 1 << (w & 63)
        self.top |= 1 << m

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank and its positions, in order; None when empty."""
        if not self.top:
            return None
        m = (self.top & -self.top).bit_length() - 1
        w = (m << 6) + (self.mid[m] & -self.mid[m]).bit_length() - 1
        rank = (w << 6) + (self.low[w] & -self.low[w]).bit_length() - 1
        self.low[w] &= self.low[w] - 1
        if not self.low[w]:
            self.mid[m] &= self.mid[m] - 1
            if not self.mid[m]:
                self.top &= self.top - 1
        positions = self.buckets.pop(rank)
        positions.sort()
        return rank, positions


class Encoder(dict):
    """Ids of pre-tokens; as a dict it remembers those of short ones."""

    def __init__(self, vocabulary: bytes):
        super().__init__()
        model = json.loads(vocabulary)["model"]
        vocab = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.byte_ids = [vocab[s] for s in byte_symbols()]
        self.left = [vocab[a] for a, _ in merges]
        self.right = [vocab[b] for _, b in merges]
        self.whole = [vocab[a + b] for a, b in merges]
        self.ranks = {a << 20 | b: r for r, (a, b) in enumerate(zip(self.left, self.right))}
        self.queue = RankQueue(len(merges))
        self.find = regex.compile(PATTERN).findall

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.merge(piece.encode("utf-8")))
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids

    def merge(self, data: bytes) -> list[int]:
        """Byte-pair merges of one pre-token."""
        ranks, queue, n = self.ranks, self.queue, len(data)
        token = [self.byte_ids[b] for b in data]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for i in range(n - 1):
            r = ranks.get(token[i] << 20 | token[i + 1])
            if r is not None:
                queue.push(r, i)
        while (got := queue.pop()) is not None:
            rank, positions = got
            a, b, new = self.left[rank], self.right[rank], self.whole[rank]
            for p in positions:
                q = after[p]
                if token[p] != a or q >= n or token[q] != b:
                    continue  # stale
                token[p], token[q] = new, -1
                nxt, prev = after[q], before[p]
                after[p] = nxt
                if nxt < n:
                    before[nxt] = p
                    r = ranks.get(new << 20 | token[nxt])
                    if r is not None:
                        queue.push(r, p)
                if prev >= 0:
                    r = ranks.get(token[prev] << 20 | new)
                    if r is not None:
                        queue.push(r, prev)
        return [t for t in token if t >= 0]

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.find(text))))


_encoders: dict[int, Encoder] = {}


def _kernel(vocabulary, key: int):
    def run(batches):
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = Encoder(vocabulary.value)
        enc = _encoders[key]
        get, find = enc.__getitem__, enc.find
        for b in batches:
            ids, ends, first = array("i"), [0], 0
            for i, text in enumerate(b.column(1)):
                t = text.as_py()
                if t:
                    ids.extend(chain.from_iterable(map(get, find(t))))
                ends.append(len(ids))
                if len(ids) >= BATCH_IDS or i + 1 == b.num_rows:
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.int32(), len(ids), [None, pa.py_buffer(ids)]))
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(first, i + 1 - first), lists], ["doc_id", "ids"])
                    ids, ends, first = array("i"), [0], i + 1

    return run


def encode_corpus(documents: DataFrame, path: str = DEFAULT_PATH) -> DataFrame:
    """doc_id and ids of every document, by the tokenizer file at `path`."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    schema = T.StructType([documents.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])
    shared = documents.sparkSession.sparkContext.broadcast(data)
    return documents.select("doc_id", F.col("text")).mapInArrow(_kernel(shared, hash(data)), schema)
