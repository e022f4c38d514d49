"""Vectorised rolling fingerprints and minimiser selection over one flat symbol array.

Everything here is plain numpy on the worker: a batch of texts is concatenated into one array of symbols
(bytes, or 64-bit word fingerprints) and all windows of all texts are fingerprinted at once.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

U64 = np.uint64
#: Two odd multipliers; with both, a window fingerprint has 128 bits.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            out = np.ones(size, U64)
            done = 1
            while done < size:  # doubling: b**(i + done) = b**i * b**done
                out[done : 2 * done] = out[:done] * U64(pow(b, done, 1 << 64))
                done *= 2
            pair.append(out)
        have = _POWERS[base] = (pair[0], pair[1])
        if size > 1 << 24:
            _POWERS.pop(base)
    return have


class Fingerprints:
    """Fingerprints of any stretch of a symbol array from prefix sums modulo 2**64."""

    def __init__(self, symbols: np.ndarray, base: int = BASES[0]):
        n = len(symbols)
        up, self.down = powers(base, n + 1)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(symbols.astype(U64, copy=False) * up[:n], out=self.sums[1:])

    def of(self, starts: np.ndarray, lengths) -> np.ndarray:
        return mix((self.sums[starts + lengths] - self.sums[starts]) * self.down[starts])

    def all(self, length: int) -> np.ndarray:
        """Of every window of that length, in order of its start."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, U64)
        return mix((self.sums[length:] - self.sums[:n]) * self.down[:n])


#: Low bits of a packed key that hold the position; the fingerprint's other bits order. One fixed number everywhere, so that
#: equal windows choose alike in every batch. Flat arrays are shorter than 2**POS_BITS symbols.
POS_BITS = 28


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` fingerprints the index of its least one, the leftmost of equal ones."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = U64((1 << POS_BITS) - 1)
    key = (values & ~low) | np.arange(len(values), dtype=U64)
    if width <= 32:
        span = 1
        while span * 2 <= width:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        best = np.minimum(key[:n], key[width - span : width - span + n]) if span < width else key[:n]
    else:  # least of each block's beginning and end
        blocks = np.full(-(-len(key) // width) * width, ~U64(0))
        blocks[: len(key)] = key
        blocks = blocks.reshape(-1, width)
        head = np.minimum.accumulate(blocks, axis=1).ravel()
        tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        best = np.minimum(tail[:n], head[width - 1 : width - 1 + n])
    return (best & low).astype(np.int64)


SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+` in UTF-8 bytes."""
    sep = SEPARATOR[raw]
    edge = np.empty(len(raw) + 1, bool)
    edge[0], edge[-1] = True, True
    edge[1:-1] = sep[1:] != sep[:-1]
    cuts = np.flatnonzero(edge)
    if len(cuts) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, ends = cuts[:-1], cuts[1:]
    word = ~sep[starts]
    return starts[word], ends[word]


def word_symbols(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit symbols of every word: the halves of a 128-bit digest of its bytes, computed once per distinct word.

    A digest and no power sum: words made to collide modulo 2**64 stay apart.
    """
    words = raw.tobytes().split()  # splits at the same six bytes as word_bounds()
    code = {w: i for i, w in enumerate(set(words))}
    digests = np.frombuffer(b"".join([blake2b(w, digest_size=16).digest() for w in code]), U64).reshape(-1, 2)
    at = np.fromiter(map(code.__getitem__, words), np.int64, len(words))
    return digests[at, 0], digests[at, 1]


def flat_texts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array with one newline between, and the offset of each (one more at the end)."""
    parts = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter((len(p) for p in parts), np.int64, len(parts))
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum(sizes + 1, out=offsets[1:])
    return np.frombuffer(b"\n".join(parts) + b"\n", np.uint8), offsets
