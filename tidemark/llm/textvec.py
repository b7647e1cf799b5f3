"""Words and their 64-bit hashes for a whole Arrow batch at once, in numpy.

Texts stay in one byte buffer; a polynomial prefix sum modulo 2**64 gives the hash of any byte span in constant time.
Hashes are the same in every task. Equality of spans is taken from 64-bit hashes; two different spans agree with
probability about 2**-64.
"""

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20  # bytes handled at once; one longer text makes a chunk of its own
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = {"n": 0}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that scatters close values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int):
    if _powers["n"] < n:
        size = max(n, CHUNK + 1024)
        for name, base in (("up", _BASE), ("down", _INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
        _powers["n"] = size
    return _powers["up"][:n], _powers["down"][:n]


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return buf + ((buf >= 65) & (buf <= 90)).astype(np.uint8) * np.uint8(32)


#: Bytes that separate words: space and the five control characters from tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of letters and digits; every byte above ASCII counts as part of a word.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
LETTER = WORD.copy()
LETTER[48:58] = False


class Chunk:
    """Texts ``first`` to ``first + n`` of a batch: their bytes and, from ``split``, their words."""

    def __init__(self, first: int, buf: np.ndarray, offsets: np.ndarray):
        self.first, self.buf, self.offsets, self.n = first, buf, offsets, len(offsets) - 1

    def split(self, member: np.ndarray) -> None:
        """Words are maximal runs of bytes in ``member`` within one text: ``start``, ``end``, ``doc``, and per text
        ``word_offsets`` and ``counts``."""
        inside = member[self.buf] if len(self.buf) else np.zeros(0, bool)
        before = np.empty_like(inside)
        if len(inside):
            before[0] = False
            before[1:] = inside[:-1]
            cuts = self.offsets[1:-1]
            before[cuts[cuts < len(inside)]] = False
            after = np.empty_like(inside)
            after[-1] = False
            after[:-1] = inside[1:]
            last = self.offsets[1:] - 1
            after[last[last >= 0]] = False
            # an empty text shares its boundary with the one before, which the line above has already closed
            self.start, self.end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.word_offsets = np.searchsorted(self.start, self.offsets)
        self.counts = np.diff(self.word_offsets)
        self.doc = np.repeat(np.arange(self.n), self.counts)

    def prefix_hash(self, buf: np.ndarray) -> None:
        up, self._down = _power_tables(len(buf) + 1)
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        self._sums = sums

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._down[start] + (end - start).astype(np.uint64))

    def word_hashes(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)


def text_chunks(texts: pa.Array | pa.ChunkedArray, size: int | None = None):
    """Chunks of about ``size`` (CHUNK) bytes that cover all texts in order; a null is an empty text."""
    size = size or CHUNK
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        j = min(j, len(texts))
        yield Chunk(i, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        i = j


def ngram_hashes(words: np.ndarray, doc: np.ndarray, n: int, gap: int = 0):
    """Hashes of ``n`` words in a row (with ``gap`` words left out before the last one) and the text of each."""
    reach = n + gap
    if len(words) < reach:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(words) - reach + 1
    keep = doc[:m] == doc[reach - 1:]
    acc = np.zeros(m, np.uint64)
    for k in range(n):
        at = k if k < n - 1 else k + gap
        acc = (acc + words[at:at + m]) * _BASE + np.uint64(2 * k + 1)
    return mix(acc[keep] + np.uint64(n * 1000 + gap)), doc[:m][keep]
