"""Arrow batches of texts as flat code-point arrays, for numpy work without a Python loop per character."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: White_Space of Unicode (str.isspace would add the four separators U+001C..U+001F).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def major_class() -> np.ndarray:
    """For each code point the first letter of its general category as a byte; White_Space is ``W``."""
    out = np.frombuffer("".join(unicodedata.category(chr(c))[0] for c in range(0x110000)).encode(), np.uint8).copy()
    out[WHITE_SPACE] = ord("W")
    return out


class Block:
    """Some successive texts: ``cp`` holds all code points, text i is ``cp[start[i]:start[i + 1]]``."""

    __slots__ = ("rows", "texts", "cp", "start")

    def __init__(self, rows: np.ndarray, texts: list[str]):
        self.rows, self.texts = rows, texts
        self.cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.start = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=self.start[1:])

    def text_of_char(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.texts), dtype=np.int32), np.diff(self.start))

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a per-character array over each text; 0 for empty texts."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.start[1:]] - total[self.start[:-1]]


def blocks(column: pa.Array | pa.ChunkedArray, most_chars: int = 1 << 20) -> Iterator[Block]:
    """Cuts a text column into blocks of about ``most_chars``; null counts as empty text. A text is never cut."""
    texts = column.to_pylist()
    rows: list[int] = []
    held: list[str] = []
    n = 0
    for i, t in enumerate(texts):
        t = t or ""
        if held and n + len(t) > most_chars:
            yield Block(np.array(rows), held)
            rows, held, n = [], [], 0
        rows.append(i)
        held.append(t)
        n += len(t)
    if held:
        yield Block(np.array(rows), held)


@cache
def folding() -> np.ndarray:
    """Code point -> folded code point, 0 to drop it: compatibility form, lower case, no marks, no format
    characters, look-alike letters by their prototypes, decimal digits as ASCII. Of a ligature the first
    letter stays."""
    from corpusloom.llm.lookalikes import ARABIC, CYRILLIC, GREEK, LATIN

    out = np.arange(0x110000, dtype=np.uint32)
    alike = {ord(a): b for pairs in (ARABIC, CYRILLIC, GREEK, LATIN) for a, b in pairs.items()}
    for c in (*range(0x80, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0xE0000, 0xE0200)):
        ch = chr(c)
        if (kind := unicodedata.category(ch)) in ("Cf", "Mn", "Me"):
            out[c] = 0
        elif kind == "Nd":
            out[c] = 0x30 + unicodedata.decimal(ch)
        else:
            bare = unicodedata.normalize("NFKD", alike.get(c, ch)).translate(alike).lower()
            out[c] = next((ord(x) for x in bare if unicodedata.category(x) != "Mn"), 0)
    out[0x41:0x5B] += 0x20
    out[WHITE_SPACE] = 0x20
    return out


_ODD = np.uint64(0x9E3779B97F4A7C15)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd multiplier and of its inverse, modulo 2**64."""
    inverse = pow(int(_ODD), -1, 1 << 64)
    p, q = np.full(n, _ODD), np.full(n, np.uint64(inverse))
    p[0] = q[0] = 1
    return np.cumprod(p), np.cumprod(q)


def prefix_sums(cp: np.ndarray) -> np.ndarray:
    """Running polynomial hash: what ``slice_hash`` takes differences of."""
    n = len(cp)
    size = 1 << max(16, n.bit_length())
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * _powers(size)[0][:n], out=total[1:])
    return total


def slice_hash(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of ``cp[start:end]`` wherever it stands, mixed so that its low bits can be used."""
    size = 1 << max(16, (len(total) - 1).bit_length())
    h = (total[end] - total[start]) * _powers(size)[1][start]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def text_hash(texts: list[str]) -> np.ndarray:
    """``slice_hash`` of whole, folded texts."""
    fold, out = folding(), []
    for t in texts:
        cp = fold[np.frombuffer(t.encode("utf-32-le"), np.uint32)]
        cp = cp[cp > 0]
        out.append(slice_hash(prefix_sums(cp), np.array([0]), np.array([len(cp)]))[0])
    return np.array(out, np.uint64)
