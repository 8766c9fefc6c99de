"""Keyword-stuffed and link-list pages.

The message and the changed lines of a commit are read as a sequence of lines;
each line becomes a symbol (what it looks like) and a word count. A hidden
Markov model with the states prose, link list, tag list and menu labels the
lines, so a line that looks harmless inside a run of spam, or a link inside a
paragraph, takes the label of its surroundings. A document is spam if the lines
not labelled prose hold at least `share` of its words. Code counts as prose.

No word list is used, in any language: a keyword line is one whose words come
again and again, in itself or on the other lines of its text, without sentences
around them. Words are letters with their marks; a script without blanks between
words is read in pairs of letters.

The model's probabilities are learnt once, by counting over labelled lines
(`spam_pages`, a bounded sample of PAGES made-up pages), and stored here, so the
label of a page depends on nothing but the page. One narrow map, no shuffle.

Defined results: NULL, empty and blank texts, and texts without words in their
message and changed lines, are no spam; repeated rows are judged each; lines may
end in LF, CR LF or CR; other columns are ignored, whatever they are called.
Texts are read whole; a line's cost is linear in its length.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATES = ["prose", "link list", "tag list", "menu"]
#: P sentence, C code or data, R link definition, S few words, N link, K keywords, T tags, M cells of a table or menu.
SYMBOLS = "PCRSNKTM"
SHARE = 0.5
#: Pages of the labelled sample that the stored model is counted on.
PAGES = 4_000
#: Words of a line that make one step of the model.
PART_WORDS = 16
#: Words of a text from which repetition across its lines counts.
REPEAT_WORDS = 20
#: A word comes again and again if it makes up one of so many words of a text.
REPEAT_RATE = 60
#: Share of a line's words that must come again and again.
REPEAT_SHARE = 0.7
#: A symbol that says nothing about the state: its share is one for all states.
TIED = SYMBOLS.index("S")

_HEADER = re.compile(r"(?:commit [0-9a-f]{7,}|(?:Author|AuthorDate|Commit|CommitDate|Committer|Date|From|To|Cc|Merge|Message-Id|Reply-To)\b ?:|From [0-9a-f]{7,}|---\s*$|-- ?$)", re.I)
_ID_LINE = re.compile(r"(?:commit|From) [0-9a-f]{7,}")
_SUBJECT = re.compile(r"Subject:\s*(?:\[[^\]]*\]\s*)*", re.I)
_HUNK = re.compile(r"@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@")
_IN_DIFF = re.compile(r"(?:diff |index |Index: |={10,}|--- |\+\+\+ |@@ |old mode |new mode |new file |deleted file |similarity |dissimilarity |rename |copy |Binary |GIT binary |literal |delta |Only in |\\ |[+ -]|$)")
_URL = re.compile(r"(?:https?://|www\.)[^\s<>\"')\]|]+", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^>]*>")
_WRAP = re.compile(r"^(?:/\*+|\*+/|//+|<!--|#(?=\s)|\*(?=\s)|--(?=\s)|;+(?=\s)|%+(?=\s)|\"\"\")\s*|\s*(?:\*+/|-->|\"\"\")\s*$")
_WORD = re.compile(r"[^\W_]+")
_MARKED_WORD = regex.compile(r"[\p{L}\p{N}][\p{L}\p{M}\p{N}]*")
_NO_BLANKS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")
_SENTENCE_END = regex.compile(r"[.!?…。！？।؟](?:\s|[\"')\]]|$)|[。！？]")
_CODE = re.compile(
    r"[{}]\s*$|^\s*[{}\[\]()]|\w\(|\)\s*[:{]?$|(?<![=<>!])=(?![=>])|[=!]=|&&|\|\||->|::|\$\{|^\s*\"[^\"]*\"\s*:|^\s*'[^']*'\s*:|^\s*(?:msgid|msgstr)\b|^\s*[\w.-]+\s*:(?:\s|$)|^\s*(?:def|class|return|import|from|func|if|for|while|else|elif|end|var|let|const|public|private|static|void|SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|FROM|WHERE|GROUP|ORDER|JOIN|echo|done|fi|then|export|package|type|struct|go|defer|memset|try|except|finally|with|raise|pass|break|continue|switch|case)\b"
)
_STATEMENT = re.compile(r"[()=<>\[\]{}'\"*&]|\w\.\w|->")
_DATA = re.compile(r"\s*(?:\"[^\"]*\"|'[^']*')\s*:|\s*[\w.-]+\s*=\s*[\"'\[{\d]|\s*INSERT\s+INTO\b", re.I)
_IDENT = re.compile(r"\s*(?:[a-z0-9]+(?:[A-Z][a-z0-9]*)+|\w*_\w+|[a-z]+\d+)\s*[,;]?\s*$")
_DEFINITION = re.compile(r"\s*\[[^\]\s]+\]:\s*(?:https?://|www\.)", re.I)
_PATH = re.compile(r"[#*\s]*[\w.@-]*(?:/[\w.@-]+)+/?\s*(?:\|.*)?$")
_KEY = re.compile(r"\S*[A-Za-z0-9+/=]{24,}\S*$")
_ATTRIBUTE = re.compile(r"\b(?:content|alt|title|value)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", re.I)
_MARK = re.compile(r"(?:[#@]|\w+:)(?=[^\W_])")
_HUMP = re.compile(r"[a-zß-ÿа-яё0-9][A-ZÀ-ÞА-ЯЁ]|[a-zß-ÿа-яё]\d+$")
_SPLIT = re.compile(r"[,;|•★✅·►→»/]|\s[-–—]\s")
_REMOTE = re.compile(r"\b\w+://\S+")
_EMPTY = re.compile(r"\(\s*\)|\[\s*\]|<\s*>")
_FIELD = re.compile(r"[:=_/(\\]")
_SENTENCE = re.compile(r"[.!?…:](?:\s|$)|;\s|,\s")


def _opens_diff(lines: list[str], i: int) -> bool:
    """Does a patch begin at line i? Its own marks must stand there, not just a
    word that patches begin with."""
    line = lines[i]
    if line.startswith("diff --git ") or _HUNK.match(line):
        return True
    if line.startswith("--- "):
        return i + 1 < len(lines) and lines[i + 1].startswith("+++ ")
    if line.startswith(("diff -", "Index: ")):
        return any(x.startswith(("--- ", "+++ ", "===")) or _HUNK.match(x) for x in lines[i + 1 : i + 4])
    return False


def changed_lines(text: str) -> list[str]:
    """Message lines, then added and removed lines without their mark. Left out
    are the header of a commit (the block of header lines at its top) and, inside
    a patch, its context and file headers; a line no patch can hold ends it."""
    lines, out, in_diff = re.split(r"\r\n|\n|\r", text), [], False
    at = next((i for i, x in enumerate(lines) if x.strip()), len(lines))
    end = at
    while end < len(lines) and _HEADER.match(lines[end]):
        end += 1
    # one line alone may be anything, unless it names a commit
    skip = range(at, end) if end - at > 1 or end > at and _ID_LINE.match(lines[at]) else range(0)
    for i, line in enumerate(lines):
        if in_diff and not _IN_DIFF.match(line):
            in_diff = False
        if not in_diff and line and line[0] in "dI-@" and _opens_diff(lines, i):
            in_diff = True
        if in_diff:
            if line[:1] in "+-" and line[:1] and not line.startswith(("+++ ", "--- ")) and line.rstrip() != "--":
                out.append(line[1:])
        elif i not in skip:
            out.append(_SUBJECT.sub("", line, count=1) if line.startswith(("Subject", "subject")) else line)
    return out


def _tags(bare: str, pieces: list[str]) -> bool:
    """Marked tags (#Tag, tag:Tag) or a list of compound words (BestTagSale)."""
    tokens = [t for t in _SPLIT.sub(" ", bare).split() if _WORD.search(t)]
    if len(tokens) == 1 and tokens[0][0] in "#@":
        return tokens[0][1:2] != tokens[0][1:2].lower() or tokens[0][1:2].isdigit() and bool(_HUMP.search(tokens[0]))
    marked = sum(bool(_MARK.match(t)) for t in tokens)
    if "=" in bare or "(" in bare or "_" in bare or '"' in bare:
        return False
    if marked >= 2 and marked * 4 >= 3 * len(tokens):
        return sum(bool(_HUMP.search(t)) for t in tokens) * 3 >= len(tokens) or bare[0] in "#@"
    if len(tokens) < 3 or len(pieces) < len(tokens) - 1:
        return False
    return sum(bool(_HUMP.search(t.strip(",;|"))) for t in tokens) * 3 >= len(tokens) and tokens[0][:1] == tokens[0][:1].upper()


def _is_code(line: str, words: int) -> bool:
    """Code by its marks; a semicolon at the end of many plain words is none."""
    return bool(_CODE.search(line)) or line.endswith(";") and (words <= 4 or bool(_STATEMENT.search(line)))


def _keywords(line: str, low: list[str]) -> bool:
    """A line of five words or more that repeats words."""
    m, count = len(low), Counter(w for w in low if len(w) > 3)
    often = [c for _, c in count.most_common(2) if c >= 3]
    if "\"" in line or "'" in line and "(" in line:
        return False  # a repeated word inside a literal
    return bool(often) and often[0] * 5 >= m or len(often) == 2 and sum(often) * 4 >= m


def _beside_links(left: str) -> str:
    """What the words of a line are without its URLs and markup."""
    low = [w.lower() for w in _WORD.findall(left)]
    if len(low) <= 8:
        return "P"
    if _tags(left, [p for p in _SPLIT.split(left) if p.strip()]):
        return "T"
    if _is_code(left, len(low)):
        return "P"
    return "K" if _keywords(left, low) else "P"


def symbol(line: str) -> tuple[str, int]:
    """What a line looks like by itself, and its number of words; no symbol
    without words."""
    line = line.strip()
    words = _WORD.findall(line)
    n = len(words)
    if not n:
        return "", 0
    bare = _WRAP.sub("", line)
    if "://" in line or "www." in line:
        if _DEFINITION.match(line):
            return "R", n
        if line[0] in "\"'{" or re.match(r"[\w\"'.-]+\s*[:=]\s*[\"']", line):
            return "C", n
        left = _TAG.sub(" ", _URL.sub(" ", bare))
        if len(_WORD.findall(left)) > 8:
            return _beside_links(_EMPTY.sub(" ", _REMOTE.sub(" ", left)).strip()), n
        said = left.strip(" \t-*#>[](){}|:,;")
        return ("P" if _SENTENCE_END.search(said) and len(_terms(said)) >= 4 else "N"), n
    if "<" in bare:
        bare = _told(bare)
        words = _WORD.findall(bare)
        if not words:
            return "C", n
    if _IDENT.match(bare) or _PATH.match(bare) or _KEY.match(bare):
        return "C", n
    low = [w.lower() for w in words]
    m = len(low)
    pieces = [p for p in _SPLIT.split(bare) if p.strip()] if m >= 3 else []
    if _tags(bare, pieces):
        return "T", n
    if _DATA.match(line) or bare == line and _is_code(line, m):
        return "C", n
    if m >= 5 and _keywords(line, low):
        return "K", n
    if line.count("|") >= 2 and m <= 4 * line.count("|"):
        return "M", n
    if len(pieces) >= 3 and len(pieces) * 4 >= m and not re.search(r"[.!?](?:\s|$)", bare):
        return "M", n
    return ("S" if m <= 4 else "P"), n


def _told(bare: str) -> str:
    """What a line of markup says: its text and its spoken attributes."""
    told = " ".join(x or y for x, y in _ATTRIBUTE.findall(bare))
    return (_TAG.sub(" ", bare) + " " + told).strip()


def _said(line: str) -> str:
    """A line without its URLs and markup."""
    line = _URL.sub(" ", line) if "://" in line or "www." in line else line
    return _told(line) if "<" in line else line


def _terms(line: str) -> list[str]:
    """Words of more than three letters; of scripts without blanks, pairs of
    letters."""
    out = []
    for w in _MARKED_WORD.findall(line.lower()):
        if not w.isascii() and _NO_BLANKS.search(w):
            out += [w[i : i + 2] for i in range(len(w) - 1)] or [w]
        elif len(w) > 3 or not w.isascii() and len(w) > 2:
            out.append(w)
    return out


def _repeating(lines: list[str]) -> list[bool]:
    """Which lines consist of words that come again and again in the text, and
    make no sentence. A word counts if it stands there three times or more and
    makes up one of REPEAT_RATE words."""
    terms = [_terms(x) for x in lines]
    count = Counter(w for t in terms for w in t)
    total = sum(count.values())
    if total < REPEAT_WORDS:
        return [False] * len(lines)
    least = max(3, total / REPEAT_RATE)
    often = {w for w, c in count.items() if c >= least}
    if not often:
        return [False] * len(lines)
    return [bool(t) and sum(w in often for w in t) >= REPEAT_SHARE * len(t) and not _SENTENCE_END.search(x) for x, t in zip(lines, terms)]


def line_symbols(lines: list[str]) -> list[tuple[str, int]]:
    """Symbol and words of each line, given all lines of the text."""
    marks = [symbol(x) for x in lines]
    asked = [i for i, (x, (s, _)) in enumerate(zip(lines, marks)) if s in ("P", "S", "M") and not (s == "S" and _FIELD.search(x)) and "\"" not in _WRAP.sub("", x.strip())[:1]]
    again = {i for i, yes in zip(asked, _repeating([_said(lines[i]) for i in asked])) if yes}
    return [("K" if i in again else s, n) for i, (s, n) in enumerate(marks)]


def describe(text: str | None) -> tuple[str, list[int]]:
    """Symbols and word counts of the lines of a commit that have words; a line
    of many words counts as several."""
    if not text:
        return "", []
    symbols, words = [], []
    for s, n in line_symbols(changed_lines(text)):
        if s:
            parts = -(-n // PART_WORDS)
            symbols.append(s * parts)
            words += [n * (k + 1) // parts - n * k // parts for k in range(parts)]
    return "".join(symbols), words


# Learnt values: what `python -m gapfold.llm.spam_pages` prints.
FIRST = [0.999251, 0.00025, 0.00025, 0.00025]
MOVE = [[0.983817, 0.009477, 0.005381, 0.001325], [0.000302, 0.999093, 0.000302, 0.000302], [0.000558, 0.000558, 0.998327, 0.000558], [0.001988, 0.001988, 0.001988, 0.994036]]
EMIT = [[0.240488, 0.381119, 0.08646, 0.107671, 0.077885, 0.006297, 4.5e-05, 0.100036], [0.018882, 0.000286, 0.000286, 0.107671, 0.867439, 0.004864, 0.000286, 0.000286], [0.082606, 0.000467, 0.000467, 0.107671, 0.000467, 0.511036, 0.296821, 0.000467], [0.001659, 0.001659, 0.001659, 0.107671, 0.001659, 0.869109, 0.001659, 0.014927]]


class Model:
    """Parameters as probabilities: first (s), move (s, s), emit (s, symbols)."""

    def __init__(self, first: np.ndarray, move: np.ndarray, emit: np.ndarray):
        tied = emit[:, TIED].sum() / emit.sum()
        rest = np.delete(np.arange(emit.shape[1]), TIED)
        emit = emit.copy()
        emit[:, rest] *= (1 - tied) / emit[:, rest].sum(1, keepdims=True)
        emit[:, TIED] = tied
        self.first, self.move, self.emit = (v / v.sum(-1, keepdims=True) for v in (first, move, emit))

    @staticmethod
    def counted(pages: list[tuple[str, list[int]]], weight: float = 1.0) -> "Model":
        """The model of labelled sequences (symbols, state of each), every
        probability smoothed by `weight` counts."""
        first, move, emit = np.full(4, weight), np.full((4, 4), weight), np.full((4, len(SYMBOLS)), weight)
        for symbols, states in pages:
            for k, (c, z) in enumerate(zip(symbols, states)):
                emit[z, SYMBOLS.index(c)] += 1
                if k:
                    move[states[k - 1], z] += 1
                else:
                    first[z] += 1
        return Model(*(v / v.sum(-1, keepdims=True) for v in (first, move, emit)))

    @staticmethod
    def stored() -> "Model":
        """The model counted on the labelled sample (see spam_pages.main)."""
        return Model(np.array(FIRST), np.array(MOVE), np.array(EMIT))


def _padded(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(s) for s in lines])
    table = np.zeros(256, np.int8)
    for i, c in enumerate(SYMBOLS):
        table[ord(c)] = i
    out = np.zeros((len(lines), int(n.max(initial=0))), np.int8)
    for i, s in enumerate(lines):
        out[i, : len(s)] = table[np.frombuffer(s.encode("ascii"), np.uint8)]
    return out, n


def _batches(lines: list[str], cells: int = 400_000):
    """Numbers of the non-empty sequences, in batches of similar length."""
    order = sorted((i for i, s in enumerate(lines) if s), key=lambda i: len(lines[i]))
    k = 0
    while k < len(order):
        stop = k + 1
        while stop < len(order) and (stop + 1 - k) * len(lines[order[stop]]) <= cells:
            stop += 1
        yield order[k:stop]
        k = stop


def labels(lines: list[str], m: Model) -> list[np.ndarray]:
    """The likeliest states of each sequence."""
    out: list = [np.zeros(0, np.int8)] * len(lines)
    lf, lm, le = (np.log(np.maximum(v, 1e-12)) for v in (m.first, m.move, m.emit))
    for batch in _batches(lines):
        x, n = _padded([lines[i] for i in batch])
        b, t = x.shape
        like = le.T[x]
        score, back = lf + like[:, 0], np.zeros((b, t, 4), np.int8)
        for k in range(1, t):
            via = score[:, :, None] + lm
            back[:, k] = via.argmax(1)
            score = np.where((k < n)[:, None], via.max(1) + like[:, k], score)
        at = score.argmax(1)
        path = np.zeros((b, t), np.int8)
        for k in range(t - 1, -1, -1):
            path[:, k] = at
            if k:
                at = np.where(k < n, back[np.arange(b), k, at], at)
        for i, row, size in zip(batch, path, n):
            out[i] = row[:size]
    return out


def label_documents(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, labels (a state number per step), words, other_share (share of the
    words on lines not labelled prose; 0 without words)."""
    m = model or Model.stored()
    schema = T.StructType([documents.schema["doc_id"], T.StructField("labels", T.ArrayType(T.ByteType())), T.StructField("words", T.ArrayType(T.IntegerType())), T.StructField("other_share", T.DoubleType())])

    def run(batches):
        for b in batches:
            told = [describe(t.as_py()) for t in b.column(1)]
            got, share = labels([s for s, _ in told], m), []
            for lab, (_, w) in zip(got, told):
                n = np.array(w or [0])
                share.append(float(n[lab > 0].sum() / n.sum()) if n.sum() else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.int8())), pa.array([w for _, w in told], pa.list_(pa.int32())), pa.array(share)], ["doc_id", "labels", "words", "other_share"])

    return documents.select("doc_id", "text").mapInArrow(run, schema)


def spam_documents(documents: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id of the spam documents."""
    return label_documents(documents).where(F.col("other_share") >= share).select("doc_id")
