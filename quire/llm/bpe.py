"""p8: token ids of whole texts by a public byte-level BPE vocabulary.

A batch of texts is one array of code points. Each gets a class from a table; a finite machine that cuts text as the
vocabulary's pattern says (contractions, letters, numbers, other characters, blanks) runs over all of them at once: each
position is a transition function on the machine's few states, and composing functions is associative, so a blocked
scan gives the state before every position without a loop over characters. Where a state meets a class that opens a
piece, there is a boundary. Pieces then go through pair merging, remembered by piece; their offsets are kept, so
ids can be traced back and decoded.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import spread

#: Where the vocabulary files are; a parameter of every function that reads one.
VOCABULARIES = os.environ.get("QUIRE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.json"

# Symbols the machine reads.
LETTER, NUMBER, OTHER, BLANK, SPACE, SHORT2, SHORT3, END = range(8)
# States, named by what the piece so far is: nothing open, letters, numbers, other characters, blanks, a lone space that
# joins what follows, and a contraction with two or one characters to come.
IDLE, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_BLANKS, JOINING, MORE2, MORE1 = range(8)
# Unicode White_Space.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Endings after an apostrophe that are pieces of their own.
_SHORT = ("s", "t", "m", "d", "re", "ve", "ll")


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point: LETTER, NUMBER, BLANK or OTHER."""
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    plain = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for m in regex.finditer(pattern, plain):
            a, b = (ord(plain[m.start()]), ord(plain[m.end() - 1]))
            table[a : b + 1] = kind
    table[_WHITE] = BLANK
    return table


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """``(next state, opens a piece)`` by symbol and state."""
    go, opens = np.zeros((8, 8), np.uint8), np.zeros((8, 8), bool)
    run = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHER, BLANK: IN_BLANKS}
    for state in range(8):
        for symbol in range(8):
            if state in (MORE2, MORE1) and symbol != END:
                go[symbol, state] = MORE1 if state == MORE2 else IDLE
                continue
            if symbol == END:
                go[symbol, state], opens[symbol, state] = IDLE, True
            elif symbol == SPACE:  # the last blank before something else, and an ordinary space
                go[symbol, state], opens[symbol, state] = JOINING, True
            elif symbol in (SHORT2, SHORT3) and state not in (IN_OTHER, JOINING):
                go[symbol, state], opens[symbol, state] = (MORE1 if symbol == SHORT2 else MORE2), True
            else:
                kind = OTHER if symbol in (SHORT2, SHORT3) else symbol
                go[symbol, state] = run[kind]
                opens[symbol, state] = not (state == run[kind] or state == JOINING)
    return go, opens


_GO, _OPENS = _machine()


def states_before(symbols: np.ndarray, block: int = 256) -> np.ndarray:
    """The machine's state before each symbol, from IDLE: functions composed within blocks, then over blocks, then applied."""
    n = len(symbols)
    rows = -(-n // block)
    padded = np.full(rows * block, END, np.uint8)
    padded[:n] = symbols
    grid = padded.reshape(rows, block).T
    whole = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for column in grid:  # all blocks advance together
        whole = np.take_along_axis(_GO[column], whole, axis=1)
    # exclusive scan over the blocks' functions, in doubling steps
    step = 1
    while step < rows:
        later = np.take_along_axis(whole[step:], whole[:-step], axis=1)
        whole = np.concatenate([whole[:step], later])
        step *= 2
    state = np.concatenate([[IDLE], whole[:-1, IDLE]]).astype(np.uint8) if rows else np.zeros(0, np.uint8)
    out = np.empty((block, rows), np.uint8)
    for i, column in enumerate(grid):
        out[i] = state
        state = _GO[column, state]
    return out.T.reshape(-1)[:n]


def piece_starts(code: np.ndarray, text_end: np.ndarray) -> np.ndarray:
    """Indices in ``code`` (texts one after another, each followed by one END position, flagged in ``text_end``) at which a piece starts."""
    kind = classes()[code]
    kind[text_end] = END
    after = np.append(kind[1:], END)
    symbols = kind.copy()
    # a run of blanks leaves its last one to what follows; an ordinary space joins it, another blank stays alone
    last = (kind == BLANK) & (after != BLANK) & (after != END)
    symbols[last & (code == 0x20)] = SPACE
    lone = last & (code != 0x20)
    apostrophe = np.flatnonzero((code == 0x27) & ~text_end)
    for ending in _SHORT:
        fits = np.ones(len(apostrophe), bool)
        for i, ch in enumerate(ending, 1):
            at = np.minimum(apostrophe + i, len(code) - 1)
            fits &= (apostrophe + i < len(code)) & (code[at] == ord(ch)) & ~text_end[at]
        symbols[apostrophe[fits]] = SHORT2 if len(ending) == 1 else SHORT3
    opens = _OPENS[symbols, states_before(symbols)]
    opens[lone] = True
    return np.flatnonzero(opens)


class Vocabulary:
    """Merges and ids of a byte-level BPE file, ``.json`` (merge list) or ``.tiktoken`` (ranks)."""

    def __init__(self, path: str):
        self.ids: dict[bytes, int] = {}
        self.ranks: dict[bytes, int] = {}
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as f:
                model = json.load(f)["model"]
            byte = {ch: b for b, ch in byte_letters().items()}
            spell = lambda token: bytes(byte[ch] for ch in token)
            self.ids = {spell(t): i for t, i in model["vocab"].items() if all(ch in byte for ch in t)}
            for rank, merge in enumerate(model["merges"]):
                a, b = merge.split(" ") if isinstance(merge, str) else merge
                self.ranks.setdefault((spell(a), spell(b)), rank)
        else:
            with open(path, "rb") as f:
                for line in f:
                    token, rank = line.split()
                    self.ids[base64.b64decode(token)] = int(rank)
            self.ranks = None
        self.known: dict[str, tuple[int, ...]] = {}
        self.back: dict[int, bytes] | None = None

    def rank(self, a: bytes, b: bytes) -> int | None:
        return self.ids.get(a + b) if self.ranks is None else self.ranks.get((a, b))

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece: the pair of lowest rank is merged first, the leftmost of equal ones. Long pieces use a heap over a
        linked list, so a piece of n bytes costs n log n."""
        if (whole := self.ids.get(piece)) is not None and self.ranks is None:
            return (whole,)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        if len(parts) > 64:
            return self._merge_long(parts)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.rank(parts[i], parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(self.ids[p] for p in parts)

    def _merge_long(self, parts: list[bytes]) -> tuple[int, ...]:
        import heapq

        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.rank(parts[i], parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] is not a or j >= n or parts[j] is not b:
                continue
            parts[i], parts[j] = a + b, b""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := self.rank(parts[i], parts[k])) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[k]))
            if (h := before[i]) >= 0 and (r := self.rank(parts[h], parts[i])) is not None:
                heapq.heappush(heap, (r, h, parts[h], parts[i]))
        return tuple(self.ids[p] for p in parts if p)

    def of(self, piece: str) -> tuple[int, ...]:
        found = self.known.get(piece)
        if found is None:
            found = self.merge(piece.encode("utf-8", "surrogatepass"))
            if len(piece) <= 64:
                if len(self.known) >= 1 << 19:
                    self.known.clear()
                self.known[piece] = found
        return found


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary file: printable Latin-1 bytes for themselves, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{b: chr(b) for b in shown}, **{b: chr(0x100 + i) for i, b in enumerate(hidden)}}


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_batch(texts: Iterable[str | None], vocab: Vocabulary, budget: int = 1 << 19) -> Iterator[tuple[list[int], list[int]]]:
    """``(ids, ends)`` of each text: its token ids, and after each *piece* ``(code point, id count)`` flattened as ``ends``,
    so that ids can be traced to text. Texts are cut in groups of about ``budget`` code points; a longer text is a group by itself."""
    group: list[str] = []
    size = 0
    for text in texts:
        text = text or ""
        if group and size + len(text) > budget:
            yield from _encode(group, vocab)
            group, size = [], 0
        group.append(text)
        size += len(text) + 1
    if group:
        yield from _encode(group, vocab)


def _encode(texts: list[str], vocab: Vocabulary) -> Iterator[tuple[list[int], list[int]]]:
    joined = "\0".join(texts) + "\0"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    flag = np.zeros(len(code), bool)
    flag[ends] = True
    starts = piece_starts(code, flag)
    begin = 0
    cut = np.searchsorted(starts, ends)
    known, of = vocab.known, vocab.of
    for text, lo, hi in zip(texts, np.concatenate([[0], cut[:-1] + 1]) if len(cut) else [], cut):
        at = (starts[lo:hi] - begin).tolist()
        upto = at[1:] + [len(text)] if at else []
        ids: list[int] = []
        marks: list[int] = []
        for a, b in zip(at, upto):
            piece = text[a:b]
            ids += known.get(piece) or of(piece)
            marks += (b, len(ids))
        yield ids, marks
        begin += len(text) + 1


def decode(ids: Iterable[int], vocab: Vocabulary) -> str:
    """The text of ids."""
    if vocab.back is None:
        vocab.back = {i: b for b, i in vocab.ids.items()}
    return b"".join(vocab.back[i] for i in ids).decode("utf-8", "replace")


def token_ids(df: DataFrame, key: str, text: str, *, folder: str = VOCABULARIES, name: str = VOCABULARY, offsets: bool = False) -> DataFrame:
    """``(key, ids array<int>)``, with ``offsets`` also ``ends array<int>`` (after each piece: code points, ids so far).

    Null and empty texts have no ids (an empty array). Every row gives a row; whole texts; other columns are dropped.
    """
    where = _shipped(df.sparkSession, os.path.join(folder, name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(where())
        for batch in batches:
            ids, ends, first = [], [], 0
            size = 0
            for at, (own, marks) in enumerate(encode_batch(batch.column(1).to_pylist(), vocab), 1):
                ids.append(np.asarray(own, np.int32))
                ends.append(np.asarray(marks, np.int32))
                size += len(own)
                if size > 1 << 21 or at == batch.num_rows:
                    columns = [batch.column(0).slice(first, at - first), _lists(ids)]
                    yield pa.record_batch(columns + [_lists(ends)] * offsets, names=[key, "ids"] + ["ends"] * offsets)
                    ids, ends, first, size = [], [], at, 0

    kind = dict(df.dtypes)[key]
    rows = spread(df.select(F.col(key), F.col(text).cast("string")), key)
    return rows.mapInArrow(run, f"`{key}` {kind}, ids array<int>" + ", ends array<int>" * offsets)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    lengths = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32), pa.int32()))


def _shipped(spark: SparkSession, path: str) -> Callable[[], str]:
    """Where a task finds the vocabulary: sent along with the job, so that executors need no folder of the driver's."""
    spark.sparkContext.addFile(path)
    name = os.path.basename(path)

    def where() -> str:
        from pyspark import SparkFiles

        return SparkFiles.get(name)

    return where


def token_counts(df: DataFrame, key: str, text: str, *, folder: str = VOCABULARIES, name: str = VOCABULARY) -> DataFrame:
    """``(key, tokens int)``: how many ids each text has; 0 for null and empty texts. The ids themselves stay in the task."""
    where = _shipped(df.sparkSession, os.path.join(folder, name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(where())
        for batch in batches:
            n = [len(ids) for ids, _ in encode_batch(batch.column(1).to_pylist(), vocab)]
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int32())], names=[key, "tokens"])

    rows = spread(df.select(F.col(key), F.col(text).cast("string")), key)
    return rows.mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, tokens int")
