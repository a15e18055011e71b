"""Fill-in-the-middle transformation of whole texts as a pipeline of Arrow kernels.

A text is cut into units (runs of ASCII letters, any other character by itself). Two cut points, drawn from a hash of
the row's key, make a prefix, a middle and a suffix of whole units; the output is the plain text, prefix-suffix-middle
(``psm``) or suffix-prefix-middle (``spm``), each part after its mark. Per batch: the units are split into list
arrays, flattened with the index of their parent, numbered by ordinals inside the row, filtered by role, put into lists
again and joined, and the joined pieces are put together for each row. ``restore`` is the inverse: since a text that
holds a mark stays plain, the first mark met in an output is always the one that was put there.

Memory. Units take many times their bytes, so a row is cut (between units) into pieces of about ``PIECE`` bytes, and
``CHUNK`` bytes of pieces are in list form at once; the ordinals of a piece go on from those of the piece before. A
task holds one Arrow batch of texts besides, whatever the length of a text.

Nulls: a null text is an empty one, and empty texts are plain; a null key counts as an empty string. Repeated rows are
cut alike. An empty table gives no rows. The columns of the input are kept; those named like a new one are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, small_batches, utf8, whole_text

#: Marks of prefix, suffix and middle.
MARKS = (b"<P>", b"<S>", b"<M>")
#: One unit, in the bytes of UTF-8.
UNIT = rb"([A-Za-z]+|[\x00-\x7f]|[\xc2-\xf4][\x80-\xbf]+)"
#: Put after each unit to split at: no byte of UTF-8.
BREAK = b"\xff"
PIECE = 1 << 20
CHUNK = 1 << 22
RESULT = "struct<units:long,form:string,prefix_chars:long,middle_chars:long,output:string>"


def piece_cuts(data, offsets, size: int):
    """Byte places that cut the rows of a buffer into pieces: all ends of rows, and in rows of more than ``size`` bytes the
    first end of a unit at or after each ``size`` bytes. (places, first piece of each row and the number of all.)"""
    import numpy as np

    cuts, first = [0], [0]
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        at = a + size
        while at < b:
            look = data[at - 1:min(b, at + 4096)]
            low = look | 0x20
            letter = (low >= 97) & (low <= 122) & (look < 128)
            ends = np.flatnonzero(((look[1:] & 0xC0) != 0x80) & ~(letter[1:] & letter[:-1]))
            if len(ends):
                cuts.append(at + int(ends[0]))
                at = cuts[-1] + size
            else:
                at += len(look) - 1
        cuts.append(b)
        first.append(len(cuts) - 1)
    return np.array(cuts, np.int64), np.array(first, np.int64)


def binary(data, offsets):
    """A binary array over a buffer of bytes, from the places of its values."""
    import numpy as np
    import pyarrow as pa

    a = int(offsets[0])
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets - a).astype(np.int32)), pa.py_buffer(data[a:int(offsets[-1])])])


def chunked(cuts, size: int):
    """Runs (from, to) of pieces of together about ``size`` bytes."""
    import numpy as np

    at = 0
    while at < len(cuts) - 1:
        to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + size, "right")) - 1)
        yield at, to
        at = to


def joined(lists, counts):
    """The values of neighbouring lists of the given lengths, each list joined to one value."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), lists), b"")


def by_role(piece, start, low, high):
    """Prefix, middle and suffix of every piece, whose first unit has the ordinal ``start``; middles begin at the ordinal
    ``low`` and end before ``high``."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.split_pattern(pc.replace_substring_regex(piece, pattern=UNIT, replacement=rb"\1" + BREAK), pattern=BREAK)
    units, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    # each list ends in an empty value behind its last unit, which adds nothing to whatever part it falls in
    base = pc.subtract(pa.array(start), lists.offsets[:-1].cast(pa.int64()))
    ordinal = pc.add(pa.arange(0, len(units)), pc.take(base, parent))
    after = pc.greater_equal(ordinal, pc.take(pa.array(low), parent))
    behind = pc.greater_equal(ordinal, pc.take(pa.array(high), parent))
    for role in (pc.invert(after), pc.and_not(after, behind), behind):
        yield joined(units.filter(role), np.bincount(parent.filter(role).to_numpy(), minlength=len(piece)))


def transformed(text, h1, h2, h3, h4, plain_from: int, spm_below: int):
    """The struct array of RESULT for a batch of texts and four draws for each row."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    data, offsets = utf8(text)
    cuts, first = piece_cuts(data, offsets, PIECE)
    pieces = list(chunked(cuts, CHUNK))
    per_piece = [pc.count_substring_regex(binary(data, cuts[a:b + 1]), pattern=UNIT) for a, b in pieces]
    per_piece = np.concatenate(per_piece).astype(np.int64) if pieces else np.zeros(0, np.int64)
    before = np.r_[0, np.cumsum(per_piece)]
    n = before[first[1:]] - before[first[:-1]]
    x, y = (h.to_numpy(zero_copy_only=False) % (n + 1) for h in (h1, h2))
    low, high = np.minimum(x, y), np.maximum(x, y)
    raw = binary(data, offsets)
    marked = np.logical_or.reduce([pc.match_substring(raw, pattern=m).to_numpy(zero_copy_only=False) for m in MARKS]) if len(raw) else np.zeros(0, bool)
    plain = (n == 0) | marked | (h3.to_numpy(zero_copy_only=False) % 100 >= plain_from)
    spm = ~plain & (h4.to_numpy(zero_copy_only=False) % 100 < spm_below)
    row = np.repeat(np.arange(len(n)), np.diff(first))
    start = before[:-1] - before[first[:-1]][row]

    done = [[], [], []]
    for a, b in pieces:
        at = np.flatnonzero(~plain[row[a:b]])
        if len(at):
            mine = row[a:b][at]
            piece = binary(data, cuts[a:b + 1]).take(pa.array(at))
            for out, part in zip(done, by_role(piece, start[a:b][at], low[mine], high[mine])):
                out.append(part)
    of_row = np.diff(first)[~plain]
    prefix, middle, suffix = (joined(pa.concat_arrays(d) if d else pa.array([], pa.binary()), of_row) for d in done)

    turned = pa.array(spm[~plain])
    mark = [pa.scalar(m, pa.binary()) for m in MARKS]
    output = pc.binary_join_element_wise(
        pc.if_else(turned, mark[1], mark[0]), pc.if_else(turned, suffix, prefix),
        pc.if_else(turned, mark[0], mark[1]), pc.if_else(turned, prefix, suffix), mark[2], middle, pa.scalar(b"", pa.binary()),
    )
    place = np.empty(len(n), np.int64)
    place[plain], place[~plain] = np.arange(plain.sum()), plain.sum() + np.arange((~plain).sum())
    place = pa.array(place)
    gaps = pa.nulls(int(plain.sum()), pa.int64())
    chars = lambda part: pa.concat_arrays([gaps, pc.utf8_length(part.cast(pa.string())).cast(pa.int64())]).take(place)
    return pa.StructArray.from_arrays(
        [
            pa.array(n), pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm"))), chars(prefix), chars(middle),
            pa.concat_arrays([raw.filter(pa.array(plain)), output]).take(place).cast(pa.string()),
        ],
        names=["units", "form", "prefix_chars", "middle_chars", "output"],
    )


def draws(key: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the digest of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 1, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """``docs`` with ``units``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` of every row. Of 100 rows about
    ``plain_from`` are transformed, and of 100 of these ``spm_below`` begin with the suffix."""
    small_batches(docs.sparkSession)

    @F.arrow_udf(RESULT)
    def run(texts, h1, h2, h3, h4):
        return transformed(texts, h1, h2, h3, h4, plain_from, spm_below)

    made = free_name(docs, "_fim")
    names = ["units", "form", "prefix_chars", "middle_chars", "output"]
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in names]
    return docs.withColumn(made, run(whole_text(text), *draws(F.col(f"`{key}`"), seed))).select(*kept, *[F.col(f"{made}.{c}").alias(c) for c in names])


def restored(output, form):
    """The texts that a batch of outputs was made of."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    form = form.to_numpy(zero_copy_only=False)
    raw = output.cast(pa.binary())
    parts, place = [raw.filter(pa.array(form == "plain"))], [np.flatnonzero(form == "plain")]
    cut = lambda values, mark: [pc.list_element(pc.split_pattern(values, pattern=mark, max_splits=1), i) for i in (0, 1)]
    for kind, marks in (("psm", MARKS), ("spm", (MARKS[1], MARKS[0], MARKS[2]))):
        at = np.flatnonzero(form == kind)
        if len(at):
            _, rest = cut(raw.take(pa.array(at)), marks[0])
            one, rest = cut(rest, marks[1])
            other, middle = cut(rest, marks[2])
            prefix, suffix = (one, other) if kind == "psm" else (other, one)
            parts.append(pc.binary_join_element_wise(prefix, middle, suffix, pa.scalar(b"", pa.binary())))
            place.append(at)
    return pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(place)))).cast(pa.string())


def restore(made: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """``made`` with ``restored``, the exact text, rebuilt from output and form alone."""
    run = F.arrow_udf(restored, "string")
    return made.withColumn("restored", run(F.col(output), F.col(form)))
