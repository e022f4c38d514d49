"""SentencePiece encoding and decoding by vectorised merge rounds.

A batch's distinct words lie in one flat array of symbols. Each round finds every word's least pair rank by a segmented
minimum, merges the leftmost pair of that rank in all words at once and compacts; words without a pair left leave the
array. Where no pair with the new piece can rank as low as the merge itself, all non-overlapping pairs of that rank in a
word merge in one round (the same result, fewer rounds). Words end before each run of spaces and around line ends, and
long ones also between characters that no piece holds side by side, so nothing can merge across a border.

Defined results: a null text counts as empty (no ids, empty decoded text); repeated rows each get a row; extra columns are
kept out of the result unless named; an empty table gives no rows; texts of any length are encoded whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewatch.llm.base import carried, map_batches

SPACE = "▁"
WORD = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
#: Words kept in a worker's cache before it is emptied; bounds memory, not results.
CACHE = 120_000
LONG = 48
NONE = np.int32(2**31 - 1)


class Pieces:
    """Tables of one model, and a bounded cache of encoded words."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.n = sp.vocab_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        bytes_, usual = {}, []
        for i in range(n):
            if sp.is_byte(i):
                bytes_[int(pieces[i][1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                usual.append(i)
        self.byte = np.array([bytes_.get(b, sp.unk_id()) for b in range(256)], np.int32)
        scores = np.array([sp.get_score(i) for i in range(n)])
        ranks = np.unique(-scores[usual], return_inverse=True)[1]
        self.rank = np.full(n, NONE, np.int32)
        self.rank[usual] = ranks
        self.id = {pieces[i]: i for i in usual}
        chars = sorted({c for i in usual for c in pieces[i]})
        self.char = {c: self.id.get(c, n + k) for k, c in enumerate(chars)}  # from n on: characters that are no piece
        self.lone = {n + k: c for k, c in enumerate(chars) if c not in self.id}
        self.other = self.span = n + len(chars)
        self.symbol = np.full(0x110000, self.other, np.int32)  # of each code point
        self.symbol[[ord(c) for c in self.char]] = list(self.char.values())
        part = lambda s: self.id.get(s) if s in self.id else self.char[s] if len(s) == 1 else None
        found = {}
        for i in usual:
            p = pieces[i]
            for k in range(1, len(p)):
                if (a := part(p[:k])) is not None and (b := part(p[k:])) is not None:
                    found[a * self.span + b] = i
        keys = np.array(sorted(found), np.int64)
        self.keys, self.to = np.append(keys, np.int64(2**62)), np.append(np.array([found[k] for k in keys.tolist()], np.int32), np.int32(0))
        lowest = np.full(self.span + 1, NONE, np.int32)  # of any pair with this symbol
        for side in (keys // self.span, keys % self.span):
            np.minimum.at(lowest, side, self.rank[self.to[:-1]])
        self.alone = lowest[:n] > self.rank  # no pair with this piece ranks as low as the piece
        self.beside = {p[k : k + 2] for p in (pieces[i] for i in usual) for k in range(len(p) - 1)}
        shown = [bytes([int(pieces[i][1:-1], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else pieces[i].replace(SPACE, " ").encode() for i in range(n)]
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_at = np.zeros(n + 1, np.int64)
        np.cumsum([len(s) for s in shown], out=self.shown_at[1:])
        self.cache: dict[str, bytes] = {}

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, or -1."""
        key = left.astype(np.int64) * self.span + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.to[at], -1)

    def merge(self, sym: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words of these sizes, one word after the other, after all merges; and the words' new sizes."""
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # of words without a pair left: symbols, words, sizes
        word = np.repeat(np.arange(len(size), dtype=np.int32), size)
        new = np.full(len(sym), -1, np.int32)
        inside = np.flatnonzero(word[1:] == word[:-1])
        new[inside] = self.pairs(sym[inside], sym[inside + 1])
        rank = np.where(new >= 0, self.rank[new], NONE)
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, starts)
            ended = least == NONE
            sizes = np.diff(np.r_[starts, len(sym)])
            if ended.any():
                stay = np.repeat(~ended, sizes)
                done.append((sym[~stay], word[starts[ended]], sizes[ended]))
                sym, word, new, rank = sym[stay], word[stay], new[stay], rank[stay]
                least, sizes = least[~ended], sizes[~ended]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(least, sizes))
            first = np.r_[True, word[at[1:]] != word[at[:-1]]]
            run = np.r_[True, at[1:] != at[:-1] + 1] | first  # of overlapping pairs every other one from the left
            begin = np.flatnonzero(run)
            place = np.arange(len(at)) - np.repeat(begin, np.diff(np.r_[begin, len(at)]))
            at = at[first | (self.alone[new[at]] & (place % 2 == 0) & self.alone[new[at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]]])]
            sym[at] = new[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            sym, word, new, rank = sym[keep], word[keep], new[keep], rank[keep]
            at = moved[at]
            beside = np.zeros(len(sym), bool)
            beside[at] = True
            beside[at[at > 0] - 1] = True
            touched = np.flatnonzero(beside)
            last = np.append(word[1:] != word[:-1], True)[touched]
            new[touched] = -1
            rank[touched] = NONE
            touched = touched[~last]
            made = self.pairs(sym[touched], sym[touched + 1])
            new[touched] = made
            rank[touched] = np.where(made >= 0, self.rank[made], NONE)
        left = np.zeros(len(size), np.int64)
        for _, of, n in done:
            left[of] = n
        begin = np.cumsum(left) - left
        out = np.empty(int(left.sum()), np.int32)
        for ids, of, n in done:
            out[np.arange(len(ids)) + np.repeat(begin[of] - (np.cumsum(n) - n), n)] = ids
        return out, left

    def encode_words(self, words: list[str]) -> None:
        """Encodes words into the cache."""
        parts: list[str] = []
        cut: list[tuple[int, int, int]] = []  # words of several parts: word, its first part, behind its last one
        for k, w in enumerate(words):
            if len(w) <= LONG:
                parts.append(w)
            else:
                a, first = 0, len(parts)
                for b in range(1, len(w) + 1):
                    if b == len(w) or w[b - 1 : b + 1] not in self.beside:
                        parts.append(w[a:b])
                        a = b
                cut.append((k, first, len(parts)))
        points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        ids, sizes = self.merge(self.symbol[points], np.fromiter(map(len, parts), np.int64, len(parts)))
        ends = np.cumsum(sizes)
        raw, at = ids.tobytes(), [0, *(4 * ends).tolist()]
        out = [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        for k in np.unique(np.searchsorted(ends, np.flatnonzero(ids >= self.n), "right")).tolist():
            out[k] = self.fallen(parts[k], ids[at[k] // 4 : at[k + 1] // 4])
        for k, first, last in reversed(cut):
            out[first:last] = [b"".join(out[first:last])]
        self.cache.update(zip(words, out, strict=True))

    def fallen(self, part: str, ids: np.ndarray) -> bytes:
        """The ids of a part with characters that are no piece, which fall back to bytes."""
        flat: list[int] = []
        at = 0
        for s in ids.tolist():
            if s >= self.n:
                flat += self.byte[list(part[at].encode("utf-8", "surrogatepass"))].tolist()
                at += 1
            else:
                flat.append(s)
                at += self.length(s)
        return np.array(flat, np.int32).tobytes()

    def length(self, piece: int) -> int:
        return len(self.shown[self.shown_at[piece] : self.shown_at[piece + 1]].tobytes().decode())

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as int32 bytes."""
        split = [WORD.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.cache) >= CACHE:
            self.cache.clear()
        missing = {w for ws in split for w in ws}.difference(self.cache)
        if missing:
            self.encode_words(list(missing))
        get = self.cache.__getitem__
        return [b"".join(map(get, ws)) for ws in split]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of flat ids."""
        lengths = (self.shown_at[1:] - self.shown_at[:-1])[ids]
        ends = np.cumsum(lengths)
        flat = self.shown[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.shown_at[ids] - (ends - lengths), lengths)].tobytes()
        cuts = np.r_[0, ends][offsets].tolist()
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            raw = flat[a:b]
            out.append((raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace"))
        return out


_MODELS: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    return _MODELS.get(path) or _MODELS.setdefault(path, Pieces(path))


def encode_pieces(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), decoded: str | None = None) -> DataFrame:
    """The columns named in keep and ids (array of int) of every whole text, without begin or end ids.

    With decoded, a column of that name has the text decoded from those ids: the same as decode_pieces() afterwards, with
    one worker per task instead of two.
    """
    rows, ddl, rest, _ = carried(docs, text, keep, ("ids", decoded) if decoded else ("ids",))

    def encoded(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = model(path).encode(batch.columns[-1].to_pylist())
        offsets = np.zeros(len(found) + 1, np.int32)
        np.cumsum([len(b) // 4 for b in found], out=offsets[1:])
        flat = np.frombuffer(b"".join(found), np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
        more = [pa.array(model(path).decode(flat, offsets.astype(np.int64)), pa.string())] if decoded else []
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], ids, *more], names=[*rest, "ids", *([decoded] if decoded else [])])

    return map_batches(rows, encoded, f"{ddl}, ids array<int>{f', `{decoded}` string' if decoded else ''}", after=lambda: model(path).cache.clear())


def decode_pieces(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The same rows and columns and the text of ids; null ids count as none."""

    def decoded(batch: pa.RecordBatch) -> pa.RecordBatch:
        col = batch.column(batch.schema.names.index(ids))
        if col.null_count:
            col = pa.array([x or [] for x in col.to_pylist()], pa.list_(pa.int32()))
        offsets = col.offsets.to_numpy().astype(np.int64)
        flat = col.values.to_numpy()[offsets[0] : offsets[-1]]
        texts = model(path).decode(flat, offsets - offsets[0])
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return map_batches(encoded, decoded, f"{ddl}, `{out}` string")
