"""BPE over whole texts with the public vocabulary files.

The merges of one piece run over a segment tree whose leaves are byte (or character) positions: a leaf holds the
rank of the pair that starts there, an inner node the least rank below it. The leftmost leaf with
the least rank is found by one descent; a merge changes the leaf of the pair, of its live left
neighbour and of the token swallowed, each in logarithmic time, so a piece of n bytes takes
O(n log n) however long it is.
"""

from __future__ import annotations

import base64
import json
import os
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the public pattern that splits a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"

_NONE = 1 << 60


def merged(n: int, rank: Callable[[int, int, int], float]) -> list[int]:
    """Where the tokens of ``n`` symbols end once no pair is left to merge.

    ``rank(a, b, c)`` is that of the tokens of the symbols a to b and b to c, ``_NONE`` if they don't merge. Always the leftmost pair of least rank
    merges next. The leaves of a segment tree are places: each holds the rank of the pair whose first token starts there.
    """
    if n < 2:
        return [n] * n
    size = 1 << max(n - 2, 0).bit_length()
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        tree[size + i] = rank(i, i + 1, i + 2)
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a <= b else b
    after = list(range(1, n + 1))  # where the token that starts here ends
    before = list(range(-1, n))  # where the token before this one starts

    def put(leaf: int, value: float) -> None:
        i = size + leaf
        tree[i] = value
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            low = a if a <= b else b
            if tree[i] == low:
                return
            tree[i] = low
            i >>= 1

    while tree[1] < _NONE:
        least, i = tree[1], 1
        while i < size:
            i += i
            if tree[i] != least:
                i += 1
        at = i - size
        gone = after[at]  # the token swallowed
        end = after[gone]
        after[at] = end
        if gone < n - 1:
            put(gone, _NONE)
        if end < n:
            before[end] = at
            put(at, rank(at, end, after[end]))
        else:
            put(at, _NONE)
        left = before[at]
        if left >= 0:
            put(left, rank(left, at, end))
    out, i = [], 0
    while i < n:
        i = after[i]
        out.append(i)
    return out


class SegmentTreeBpe:
    """Encodes with merge ranks; ``ranks`` maps the bytes of each token to its id."""

    #: entries that the memo of lines and of pieces may hold before it starts anew
    MEMO = 60_000

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=1)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self._split = regex.compile(PATTERN).findall
        self._pieces: dict[str, array] = {}
        self._lines: dict[str, array] = {}

    @classmethod
    def load(cls, path: str) -> SegmentTreeBpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def encode_piece(self, piece: bytes) -> array:
        """The ids of one piece: always the leftmost pair of least rank merges next."""
        ranks, n, longest = self.ranks, len(piece), self.longest
        whole = ranks.get(piece) if n <= longest else None
        if whole is not None:
            return array("i", (whole,))
        ends = merged(n, lambda a, _, b: ranks.get(piece[a:b], _NONE) if b - a <= longest else _NONE)
        return array("i", [ranks[piece[a:b]] for a, b in zip([0, *ends], ends, strict=False)])

    def _line(self, line: str) -> array:
        pieces, out = self._pieces, array("i")
        for p in self._split(line):
            ids = pieces.get(p)
            if ids is None:
                ids = self.encode_piece(p.encode("utf-8", "surrogatepass"))
                if len(p) <= 64:
                    if len(pieces) >= self.MEMO:
                        pieces.clear()
                    pieces[p] = ids
            out.extend(ids)
        return out

    def encode_into(self, text: str | None, out: array) -> int:
        """Append the ids of ``text`` to ``out``; their number. Null and empty texts have none.

        The text is cut in front of line breaks that follow a visible character: no token
        spans such a place, and none looks back over it, so lines can be encoded, and
        remembered, one by one.
        """
        if not text:
            return 0
        began, lines = len(out), self._lines
        sep = "\r\n" if "\r\n" in text else "\n"
        held = None
        parts = text.split(sep)
        for i, part in enumerate(parts):
            chunk = sep + part if i else part
            held = chunk if held is None else held + chunk
            if i + 1 < len(parts) and (not part or part[-1].isspace()):
                continue
            ids = lines.get(held)
            if ids is None:
                ids = self._line(held)
                if len(held) <= 400:
                    if len(lines) >= self.MEMO:
                        lines.clear()
                    lines[held] = ids
            out.extend(ids)
            held = None
        return len(out) - began

    def encode(self, text: str | None) -> list[int]:
        out = array("i")
        self.encode_into(text, out)
        return out.tolist()

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "surrogatepass")


class _Pieces:
    """A tokenizer that encodes the pieces of a text one by one and remembers them (a bounded number)."""

    MEMO = 100_000

    def __init__(self) -> None:
        self._known: dict[str, array] = {}

    def pieces(self, text: str) -> Iterable[str]:
        raise NotImplementedError

    def encode_piece(self, piece: str) -> array:
        raise NotImplementedError

    def encode_into(self, text: str | None, out: array) -> int:
        """Append the ids of ``text`` to ``out``; their number. Null and empty texts have none."""
        began, known = len(out), self._known
        for p in self.pieces(text) if text else ():
            ids = known.get(p)
            if ids is None:
                ids = self.encode_piece(p)
                if len(p) <= 64:
                    if len(known) >= self.MEMO:
                        known.clear()
                    known[p] = ids
            out.extend(ids)
        return len(out) - began

    def encode(self, text: str | None) -> list[int]:
        out = array("i")
        self.encode_into(text, out)
        return out.tolist()


class WordBpe(_Pieces):
    """BPE over the bytes of lower-case words, whose last symbol is marked as the end; white space is dropped. Ranks belong to pairs."""

    #: Fixed value: the public pattern of a word.
    WORD = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""

    def __init__(self, vocabulary: dict[str, int], merges: Iterable[tuple[str, str]], end: str = "</w>"):
        super().__init__()
        self.ids, self.end = vocabulary, end
        self.rank = {tuple(m): i for i, m in enumerate(merges)}
        self._split, self._space = regex.compile(self.WORD).findall, regex.compile(r"\s+").sub
        # printable stand-ins of the bytes: their own Latin-1 character where that is visible, else one from U+0100 on
        own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
        rest = iter(range(0x100, 0x200))
        self._sign = [chr(b) if b in set(own) else chr(next(rest)) for b in range(256)]

    @classmethod
    def load(cls, path: str) -> WordBpe:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        return cls(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], model["end_of_word_suffix"])

    def pieces(self, text: str) -> Iterable[str]:
        plain = self._space(" ", unicodedata.normalize("NFC", text))
        return self._split("".join([c.lower() for c in plain]))

    def encode_piece(self, piece: str) -> array:
        signs = [self._sign[b] for b in piece.encode("utf-8", "surrogatepass")]
        signs[-1] += self.end
        rank = self.rank
        ends = merged(len(signs), lambda a, b, c: rank.get(("".join(signs[a:b]), "".join(signs[b:c])), _NONE))
        return array("i", [self.ids["".join(signs[a:b])] for a, b in zip([0, *ends], ends, strict=False)])


class PieceBpe(_Pieces):
    """BPE over characters with spaces as visible signs: the pair that makes the piece of best score merges next; what is no piece falls back to its bytes."""

    SPACE = "▁"

    def __init__(self, scores: dict[str, float], ids: dict[str, int], bytes_: Sequence[int]):
        super().__init__()
        self.rank, self.ids, self.bytes = {p: -s for p, s in scores.items()}, ids, list(bytes_)
        self.longest = max(map(len, scores), default=1)
        # where no piece holds a space sign behind another character, texts may be cut in front of such signs
        self._cut = regex.compile(f"{self.SPACE}*[^{self.SPACE}]+|{self.SPACE}+").findall if all(self.SPACE not in p.lstrip(self.SPACE) for p in scores) else lambda t: [t]

    @classmethod
    def load(cls, path: str) -> PieceBpe:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(p.vocab_size()) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
        return cls({p.id_to_piece(i): p.get_score(i) for i in plain}, {p.id_to_piece(i): i for i in plain}, [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)])

    def pieces(self, text: str) -> Iterable[str]:
        return self._cut(self.SPACE + text.replace(" ", self.SPACE))

    def encode_piece(self, piece: str) -> array:
        rank, longest, out = self.rank, self.longest, array("i")
        ends = merged(len(piece), lambda a, _, c: rank.get(piece[a:c], _NONE) if c - a <= longest else _NONE)
        for a, b in zip([0, *ends], ends, strict=False):
            i = self.ids.get(piece[a:b])
            out.extend([i] if i is not None else [self.bytes[x] for x in piece[a:b].encode("utf-8", "surrogatepass")])
        return out


#: how a vocabulary file is read, by its ending
READERS = {".tiktoken": SegmentTreeBpe, ".json": WordBpe, ".model": PieceBpe}
_LOADED: dict[str, SegmentTreeBpe | _Pieces] = {}


def tokenizer(path: str) -> SegmentTreeBpe | _Pieces:
    """The tokenizer of a vocabulary file, loaded once in each Python worker: from the files sent with the job, else from ``path``."""
    if path not in _LOADED:
        sent = SparkFiles.get(os.path.basename(path)) if TaskContext.get() is not None else path
        _LOADED[path] = READERS[os.path.splitext(path)[1]].load(sent if os.path.exists(sent) else path)
    return _LOADED[path]


def _sent(path: str | None) -> str:
    """The path of a vocabulary file, which is sent to the executors if the driver has it."""
    where = path or vocabulary_path()
    spark = SparkSession.getActiveSession()
    if spark is not None and os.path.isfile(where):
        sent = getattr(spark.sparkContext, "_measura_files", None)
        if sent is None:
            sent = spark.sparkContext._measura_files = set()
        if where not in sent:
            sent.add(where)
            spark.sparkContext.addFile(where)
    return where


def vocabulary_path(directory: str | None = None, name: str = VOCABULARY) -> str:
    return os.path.join(directory or os.environ.get("MEASURA_TOKENIZERS") or TOKENIZER_DIR, name)


def token_ids(text: str | Column, path: str | None = None) -> Column:
    """ARRAY<INT> of token ids, without special tokens; an empty array for a null or empty text."""
    where = _sent(path)

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        bpe, flat, ends = tokenizer(where), array("i"), [0]
        for t in texts.to_pylist():
            bpe.encode_into(t, flat)
            ends.append(len(flat))
        return pa.ListArray.from_arrays(pa.array(np.asarray(ends, np.int32)), pa.array(np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32)))

    return encode(F.col(text) if isinstance(text, str) else text)


def token_count(text: str | Column, path: str | None = None) -> Column:
    """Number of tokens as INT; 0 for a null or empty text."""
    where = _sent(path)

    @F.arrow_udf("int")
    def count(texts: pa.Array) -> pa.Array:
        bpe, out = tokenizer(where), []
        for t in texts.to_pylist():
            flat = array("i")
            out.append(bpe.encode_into(t, flat))
        return pa.array(out, pa.int32())

    return count(F.col(text) if isinstance(text, str) else text)


def decoded(ids: str | Column, path: str | None = None) -> Column:
    """The text of token ids: the round trip of :func:`token_ids` (a null list gives null)."""
    where = _sent(path)

    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        bpe = tokenizer(where)
        return pa.array([None if x is None else bpe.decode(x) for x in lists.to_pylist()], pa.string())

    return decode(F.col(ids) if isinstance(ids, str) else ids)


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids) for each row of ``df``: one narrow pass over whole texts, no shuffle.

    Repeated keys give repeated rows; other columns, whatever their names, are not read.
    """
    return df.select(F.col(key), token_ids(text, path).alias("ids"))
