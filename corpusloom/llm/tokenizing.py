"""Token ids of a byte-level BPE vocabulary for whole corpora, without a regular expression.

Words are found by a finite automaton over code-point classes. A character's transition is a function
from state to state; functions compose associatively, so blocks of characters are reduced in parallel
lanes, the block functions are combined by a doubling scan, and a second pass replays every block from
its now known entry state. Each distinct word is merged once per worker (a bounded cache).
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusloom.llm.textblocks import Block, blocks, major_class
from corpusloom.session import field

# Symbols: a character's class with what must be known of its successors.
LETTER, NUMBER, OTHER, APOS_1, APOS_2, BLANK_LAST, SPACE_LAST, SPACE = range(8)
FIRST = 8  # added to the symbol of a text's first character
# States: the kind of the open word; ENDED also before the first character.
ENDED, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_SPACE, PREFIX, ONE_MORE, TWO_MORE = range(8)
STARTS = 8  # flag of a transition that begins a word


@cache
def transitions() -> np.ndarray:
    """(symbol, state) -> new state, plus STARTS where a word begins with the character."""
    t = np.zeros((16, 8), np.uint8)
    opened = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHER, APOS_1: ONE_MORE, APOS_2: TWO_MORE, BLANK_LAST: PREFIX, SPACE_LAST: ENDED, SPACE: IN_SPACE}
    for symbol, new in opened.items():
        t[symbol, :] = new | STARTS
        t[symbol + FIRST, :] = new | STARTS
    t[LETTER, [IN_LETTERS, PREFIX, ONE_MORE, TWO_MORE]] = [IN_LETTERS, IN_LETTERS, ENDED, ONE_MORE]
    t[NUMBER, [IN_NUMBERS, PREFIX]] = IN_NUMBERS
    for symbol in (OTHER, APOS_1, APOS_2):
        t[symbol, [IN_OTHER, PREFIX]] = IN_OTHER
    t[SPACE, IN_SPACE] = IN_SPACE
    return t


@cache
def _kinds() -> np.ndarray:
    major = major_class()
    kind = np.full(len(major), OTHER, np.uint8)
    kind[major == ord("L")] = LETTER
    kind[major == ord("N")] = NUMBER
    kind[major == ord("W")] = SPACE
    return kind


def symbols(b: Block) -> np.ndarray:
    cp = b.cp
    n = len(cp)
    sym = _kinds()[cp]
    ends = np.zeros(n + 2, bool)  # position is the first of a text, or past the end
    ends[b.start] = True
    ends[n:] = True
    following = np.full(n + 2, SPACE, np.uint8)
    following[:n] = sym
    last = (sym == SPACE) & (following[1 : n + 1] != SPACE) & ~ends[1 : n + 1]
    apos = np.flatnonzero(cp == 0x27)
    if len(apos):
        wide = np.zeros(n + 2, np.uint32)
        wide[:n] = cp
        one, two = wide[apos + 1], wide[apos + 2]
        in1, in2 = ~ends[apos + 1], ~ends[apos + 1] & ~ends[np.minimum(apos + 2, n + 1)]
        sym[apos[in1 & np.isin(one, [ord(c) for c in "sdmt"])]] = APOS_1
        pair = ((one == ord("l")) & (two == ord("l"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("r")) & (two == ord("e")))
        sym[apos[in2 & pair]] = APOS_2
    sym[last] = np.where(cp[last] == 0x20, BLANK_LAST, SPACE_LAST)
    sym[b.start[:-1][np.diff(b.start) > 0]] += FIRST
    return sym


def word_starts(sym: np.ndarray, width: int = 512) -> np.ndarray:
    """True where a word begins, by a scan of composed transition functions."""
    n = len(sym)
    if not n:
        return np.zeros(0, bool)
    table = transitions()
    state = (table & 7).ravel()
    lanes = -(-n // width)
    grid = np.full(lanes * width, SPACE, np.uint8)
    grid[:n] = sym
    grid = np.ascontiguousarray(grid.reshape(lanes, width).T).astype(np.intp) << 3
    f = np.tile(np.arange(8, dtype=np.uint8), (lanes, 1))
    for row in grid:  # the function of each block: where it leads from each state
        f = state[row[:, None] + f]
    step = 1
    while step < lanes:  # f[k] becomes the composition of blocks 0..k
        f[step:] = np.take_along_axis(f[step:], f[:-step].astype(np.intp), axis=1)
        step *= 2
    now = np.zeros(lanes, np.uint8)
    now[1:] = f[:-1, ENDED]
    flat, out = table.ravel(), np.empty((width, lanes), bool)
    for i, row in enumerate(grid):
        moved = flat[row + now]
        out[i] = moved >= STARTS
        now = moved & 7
    return out.T.ravel()[:n]


class Merger(dict):
    """Word bytes -> position in ``ids``; merges unknown words and keeps at most ``most`` of them."""

    def __init__(self, ranks: dict[bytes, int], most: int = 200_000):
        super().__init__()
        self.ranks, self.most, self.ids, self._widths = ranks, most, [], None

    def __missing__(self, word: bytes) -> int:
        self.ids.append(np.array(self.merge(word), np.int32))
        self[word] = at = len(self.ids) - 1
        return at

    def widths(self) -> np.ndarray:
        """Bytes by id."""
        if self._widths is None:
            self._widths = np.zeros(max(self.ranks.values()) + 1, np.int64)
            for piece, i in self.ranks.items():
                self._widths[i] = len(piece)
        return self._widths

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()
            self.ids.clear()

    def merge(self, word: bytes) -> list[int]:
        """Joins the neighbours whose union has the lowest rank, leftmost first, until none has one."""
        if (whole := self.ranks.get(word)) is not None:
            return [whole]
        ranks, n = self.ranks, len(word)
        end = list(range(1, n + 1))  # of the part that begins here
        before = list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or (j := end[i]) >= n or end[j] != stop:
                continue
            alive[j] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(word[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := ranks.get(word[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def _bytes(vocabulary: str) -> bytes:
    with open(vocabulary, "rb") as f:
        return f.read()


_MERGERS: dict[str, Merger] = {}


def merger(vocabulary: str, content: bytes | None = None) -> Merger:
    """Of that vocabulary, kept while the process lives; read from the path where no content is given."""
    if vocabulary not in _MERGERS:
        lines = (content if content is not None else _bytes(vocabulary)).splitlines()
        _MERGERS[vocabulary] = Merger({base64.b64decode(a): int(r) for a, r in (line.split() for line in lines if line.strip())})
    return _MERGERS[vocabulary]


def encode_block(b: Block, m: Merger) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts, the number of ids before each text, and the byte at which each id begins in its text."""
    at = np.flatnonzero(word_starts(symbols(b)))
    cp, n = b.cp, len(b.cp)
    byte = np.zeros(n + 1, np.int64)
    np.cumsum(1 + (cp >= 0x80).astype(np.int8) + (cp >= 0x800) + (cp >= 0x10000), out=byte[1:])
    raw = "".join(b.texts).encode("utf-8", "surrogatepass")
    cut = byte[np.append(at, n)]
    cuts = cut.tolist()
    which = np.array([m[raw[i:j]] for i, j in zip(cuts, cuts[1:])], np.int64)
    size = np.array([len(x) for x in m.ids], np.int64)
    first = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=first[1:])
    per_word = size[which]
    done = np.zeros(len(which) + 1, np.int64)
    np.cumsum(per_word, out=done[1:])
    known = np.concatenate(m.ids) if m.ids else np.zeros(0, np.int32)
    ids = known[np.repeat(first[which] - done[:-1], per_word) + np.arange(done[-1])]
    before = done[np.searchsorted(at, b.start)]
    # where the ids begin: the bytes of the ids before them, of all texts, less those of the texts before theirs
    width = m.widths()[ids]
    begins = np.append(0, np.cumsum(width))[:-1] - np.repeat(byte[b.start[:-1]], np.diff(before))
    m.trim()
    return ids, before, begins


def encode(df: DataFrame, vocabulary: str, *, key: str = "doc_id", text: str = "text", offsets: bool = False) -> DataFrame:
    """One row ``(key, ids)``, with ``offsets`` also ``(begins)``, for each row of ``df``.

    Null and empty texts give an empty list; blank text is text. No special token is produced, their
    spellings are ordinary text. ``begins`` holds the byte of the UTF-8 text at which each id begins, from which
    any slice of the ids can be traced to its place and decoded. Repeated rows stay repeated; other columns of
    ``df`` are not read. No shuffle: the cost is one pass over the text column. The vocabulary is read once here
    and sent along, so that executors need no copy of the file.
    """
    source = df.select(field(key).alias("_key"), field(text).cast("string").alias("_text"))
    numbers = T.ArrayType(T.IntegerType(), False)
    schema = T.StructType([T.StructField(key, source.schema["_key"].dataType), T.StructField("ids", numbers), *([T.StructField("begins", numbers)] if offsets else [])])
    sent = df.sparkSession.sparkContext.broadcast(_bytes(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(vocabulary, sent.value)
        for batch in batches:
            keys = batch.column(0)
            for b in blocks(batch.column(1)):
                ids, before, begins = encode_block(b, m)
                lists = [pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(x, pa.int32())) for x in ((ids, begins) if offsets else (ids,))]
                yield pa.RecordBatch.from_arrays([keys.slice(int(b.rows[0]), len(b.rows)), *lists], names=schema.names)

    return source.mapInArrow(run, schema)


def decode(ids: list[int], vocabulary: str) -> str:
    """The text whose ids these are."""
    back = _pieces(vocabulary)
    return b"".join(back[i] for i in ids).decode("utf-8", "replace")


@cache
def _pieces(vocabulary: str) -> dict[int, bytes]:
    return {r: piece for piece, r in merger(vocabulary).ranks.items()}
