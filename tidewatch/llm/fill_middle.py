"""Fill-in-middle transformation: one numpy kernel over the UTF-8 buffer of a whole Arrow batch.

The texts of a batch lie end to end in one buffer. A table gives each byte its class (letter, other first byte of a code
point, later byte); a token starts at each first byte that is no letter, and at a letter whose neighbour to the left is none
or belongs to another document. The running sum of these starts, less its value where the document begins, numbers the
tokens of every document at once, so one searchsorted finds both cuts of all rows, and another form of the same buffer with
two more offsets a row holds prefix, middle and suffix without a copy. No row is looked at in Python.

Cuts and forms are drawn by sha256 of "1:" and the key, so a rerun of a lost task gives the same rows. Nothing is shuffled;
a task holds one batch (BATCH_BYTES, or one text that is longer) and about nine bytes for each of its bytes.

restore() finds the three marks of an output by the same kind of kernel and puts the parts in order again. It needs the
output and the form only: a text that holds a mark stays plain, so the marks in an output are exactly the ones put there.

Defined results: a null text counts as empty; an empty text is plain with n = 0; a null key draws like the empty string;
rows with equal keys draw equal numbers; an empty table gives no rows; kept columns that bear the name of a made one are
carried with _ appended.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.base import arrow_schema, carried, map_batches, private, text_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many stay plain; of 100 others so many have the suffix first.
PLAIN_PERCENT, SPM_PERCENT = 10, 20

LATER, FIRST, LETTER = 0, 1, 2
#: The class of each byte.
CLASS = np.full(256, FIRST, np.uint8)
CLASS[0x80:0xC0] = LATER
for letters in (b"AZ", b"az"):
    CLASS[letters[0] : letters[1] + 1] = LETTER


def draws(key: Column, seed: int = 1) -> Column:
    """Four numbers of 32 bits: the first digits of sha256 of the seed, a colon and the key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)])


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, end to end, and where each begins; the last entry is the end."""
    if texts.offset or texts.type != pa.string():
        texts = pa.concat_arrays([texts.cast(pa.string())])
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    return np.frombuffer(data, np.uint8) if data is not None and at[-1] else np.zeros(0, np.uint8), at


def pieces_of(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The strings between neighbouring offsets of one buffer; nothing is copied but the offsets."""
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(data))


def marks(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where a mark begins: three bytes of one document. The middle byte tells which it is."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    open_ = np.flatnonzero(data[:-2] == ord("<"))
    open_ = open_[(data[open_ + 2] == ord(">")) & np.isin(data[open_ + 1], np.frombuffer(b"PSM", np.uint8))]
    return open_[open_ + 3 <= at[np.searchsorted(at, open_, side="right")]]


def cut(data: np.ndarray, at: np.ndarray, numbers: np.ndarray) -> dict[str, np.ndarray]:
    """Tokens, cuts in bytes, code points and form of each document of a buffer."""
    kind = CLASS[data]
    start = kind != LATER
    start[1:] &= (kind[1:] != LETTER) | (kind[:-1] != LETTER)
    begins = at[:-1][at[:-1] < at[1:]]
    start[begins] = True  # the last document's letters do not go on in this one
    before = np.zeros(len(data) + 1, np.int32)  # token starts before each byte
    np.cumsum(start, dtype=np.int32, out=before[1:])
    n = (before[at[1:]] - before[at[:-1]]).astype(np.int64)
    one, two = numbers[:, 0] % (n + 1), numbers[:, 1] % (n + 1)
    where = []
    for units in (np.minimum(one, two), np.maximum(one, two)):
        # the byte before which so many tokens of the document have begun and the next one begins
        found = np.searchsorted(before, before[at[:-1]] + units + 1, side="left") - 1
        where.append(np.where(units == n, at[1:], np.minimum(found, at[1:])).astype(np.int64))
    points = np.zeros(len(data) + 1, np.int32)
    np.cumsum(kind != LATER, dtype=np.int32, out=points[1:])
    held = np.zeros(len(n), bool)
    if len(found := marks(data, at)):
        held[np.searchsorted(at, found, side="right") - 1] = True
    plain = (at[1:] == at[:-1]) | held | (numbers[:, 2] % 100 >= 100 - PLAIN_PERCENT)
    return {
        "n": n, "first": where[0], "second": where[1], "plain": plain, "spm": ~plain & (numbers[:, 3] % 100 < SPM_PERCENT),
        "prefix_chars": (points[where[0]] - points[at[:-1]]).astype(np.int64), "middle_chars": (points[where[1]] - points[where[0]]).astype(np.int64),
    }


def _joined(*parts: str | pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(*parts, "")


def _thirds(data: np.ndarray, *ends: np.ndarray) -> list[pa.Array]:
    """Strings of a buffer: each row's successive pieces, by the ends of the pieces of all rows."""
    k = len(ends) - 1
    all_ = pieces_of(data, np.append(np.stack(ends[:-1], 1).ravel(), ends[-1][-1] if len(ends[-1]) else 0))
    return [all_.take(pa.array(np.arange(i, len(all_), k))) for i in range(k)]


def transformed(texts: pa.Array, numbers: np.ndarray) -> dict[str, pa.Array]:
    data, at = buffers(texts)
    c = cut(data, at, numbers)
    prefix, middle, suffix = _thirds(data, at[:-1], c["first"], c["second"], at[1:])
    psm = _joined(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)
    spm = _joined(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)
    plain, first = pa.array(c["plain"]), pa.array(c["spm"])
    none = pa.scalar(None, pa.int64())
    return {
        "n": pa.array(c["n"]),
        "form": pc.if_else(plain, "plain", pc.if_else(first, "spm", "psm")),
        "prefix_chars": pc.if_else(plain, none, pa.array(c["prefix_chars"])),
        "middle_chars": pc.if_else(plain, none, pa.array(c["middle_chars"])),
        "output": pc.if_else(plain, texts.cast(pa.string()), pc.if_else(first, spm, psm)),
    }


def restored(outputs: pa.Array, forms: pa.Array) -> pa.Array:
    """The texts that outputs were made of. In an output that is not plain the three marks part suffix, prefix and middle."""
    plain = pc.equal(forms, "plain")
    made = outputs.filter(pc.invert(plain))
    data, at = buffers(made)
    found = marks(data, at).reshape(-1, 3)
    if len(found) != len(made):
        raise ValueError("an output must hold its three marks once each")
    first, second, third = found.T
    _, one, _, two, _, three = _thirds(data, at[:-1], first + 3, second, second + 3, third, third + 3, at[1:])
    spm = pc.equal(forms.filter(pc.invert(plain)), "spm")
    whole = pc.if_else(spm, _joined(two, three, one), _joined(one, three, two))
    return pc.replace_with_mask(outputs.cast(pa.string()), pc.invert(plain), whole)


def fill_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ("doc_id",), seed: int = 1) -> DataFrame:
    """The columns in keep, then n, form, prefix_chars, middle_chars, output of every document."""
    made = ("n", "form", "prefix_chars", "middle_chars", "output")
    (drawn,) = private(docs, "draws")
    numbered = docs.withColumn(drawn, draws(F.col(f"`{key}`"), seed))
    rows, _, (*names, drawn), own = carried(numbered, text, (*keep, drawn), made)
    schema = ", ".join([*[f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names], "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"])
    target = arrow_schema(schema)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        numbers = batch.column(drawn).flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
        out = transformed(batch.column(own), numbers)
        return pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *out.values()], schema=target)

    return map_batches(rows, run, schema)


def restore(made: DataFrame, keep: tuple[str, ...] = ("doc_id",), output: str = "output", form: str = "form") -> DataFrame:
    """The columns in keep, then restored: the text of every output, from output and form alone."""
    own, how = private(made, "restored_from", "restored_by")
    rows = made.select(*[F.col(f"`{c}`") for c in keep], text_of(F.col(f"`{output}`")).alias(own), F.col(f"`{form}`").alias(how))
    schema = ", ".join([*[f"`{c}` {made.schema[c].dataType.simpleString()}" for c in keep], "restored string"])
    target = arrow_schema(schema)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        whole = restored(batch.column(own), batch.column(how))
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], whole], schema=target)

    return map_batches(rows, run, schema)
