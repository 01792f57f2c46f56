"""Fields that hold several items, split into one row per item with its place in the field."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.session import pick

#: Bytes of text that are scanned at once.
BLOCK = 1 << 20

_OTHER, _SEP, _BLANK, _EQ, _DQ, _SQ = range(6)
_CLASS = np.zeros(256, np.uint8)
_CLASS[[ord(c) for c in ";,|\t"]] = _SEP
_CLASS[ord(" ")], _CLASS[ord("=")], _CLASS[ord('"')], _CLASS[ord("'")] = _BLANK, _EQ, _DQ, _SQ

# states of the exact scan, before a byte is read
_START, _KEY, _BETWEEN, _BARE, _IN_DQ, _DQ_SEEN, _IN_SQ, _SQ_SEEN, _AFTER_EQ = range(9)
_NEXT = np.array(
    [  # other, separator, blank, =, double quote, single quote
        [_KEY, _START, _START, _AFTER_EQ, _IN_DQ, _IN_SQ],
        [_KEY, _START, _BETWEEN, _AFTER_EQ, _KEY, _KEY],
        [_BARE, _START, _BETWEEN, _AFTER_EQ, _IN_DQ, _IN_SQ],
        [_BARE, _START, _BARE, _BARE, _BARE, _BARE],
        [_IN_DQ, _IN_DQ, _IN_DQ, _IN_DQ, _DQ_SEEN, _IN_DQ],
        [_BARE, _START, _BARE, _BARE, _IN_DQ, _BARE],
        [_IN_SQ, _IN_SQ, _IN_SQ, _IN_SQ, _IN_SQ, _SQ_SEEN],
        [_BARE, _START, _BARE, _BARE, _BARE, _IN_SQ],
        [_BARE, _START, _AFTER_EQ, _BARE, _IN_DQ, _IN_SQ],
    ],
    np.uint8,
)


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offsets of its rows in them."""
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _at(places: np.ndarray, fromwhere: np.ndarray, none: np.ndarray) -> np.ndarray:
    """The first of the sorted places at or after each position, or ``none``."""
    k = np.searchsorted(places, fromwhere)
    found = np.append(places, np.iinfo(np.int64).max)[k]
    return np.minimum(found, none)


#: Bytes of a row that are scanned in a piece; the pieces of all rows go at a time.
PIECE = 1024


def _exact_quoted(kinds: np.ndarray, offsets: np.ndarray, rows: np.ndarray, quoted: np.ndarray) -> None:
    """Mark the bytes inside quotes of some rows by the transition table.

    Rows are cut into pieces of ``PIECE`` bytes. Of each piece it is found at once in which state it ends for every state it may begin in; these functions, one after another,
    give the states the pieces begin in, and with these the bytes are marked. So a row takes no more steps than two pieces, however long it is.
    """
    length = offsets[rows + 1] - offsets[rows]
    count = np.maximum(1, -(-length // PIECE))
    of = np.repeat(np.arange(len(rows)), count)
    nr = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    order = np.argsort(-np.minimum(length[of] - nr * PIECE, PIECE), kind="stable")
    of, nr = of[order], nr[order]
    at, left = offsets[rows][of] + nr * PIECE, np.minimum(length[of] - nr * PIECE, PIECE)
    live_at = np.searchsorted(-left, -np.arange(1, PIECE + 1), "right")  # pieces that are longer than a step

    begin = np.full(len(of), _START, np.uint8)
    several = np.flatnonzero(count[of] > 1)
    if len(several):
        ends = np.tile(np.arange(len(_NEXT), dtype=np.uint8), (len(of), 1))
        for step in range(int(left[0])):
            live = int(live_at[step])
            ends[:live] = _NEXT[ends[:live], kinds[at[:live] + step][:, None]]
        state, row = _START, -1
        for i in several[np.lexsort((nr[several], of[several]))].tolist():
            state = _START if of[i] != row else state
            row, begin[i] = of[i], state
            state = ends[i, state]
    state = begin
    for step in range(int(left[0]) if len(left) else 0):
        live = int(live_at[step])
        here = at[:live] + step
        now = state[:live]
        quoted[here] = (now == _IN_DQ) | (now == _IN_SQ)
        state[:live] = _NEXT[now, kinds[here]]


def _quoted(kinds: np.ndarray, offsets: np.ndarray, row_of: np.ndarray) -> np.ndarray:
    """For each byte, whether it stands inside quotes.

    The parity of the double quotes before a byte, and of the single quotes outside them, tells it in rows where each quote
    opens a value or closes it; a doubled quote closes and opens at once. Rows of any other make are scanned exactly.
    """
    n = len(kinds)

    def parity(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seen = np.concatenate([[0], np.cumsum(marks)])
        before = seen[:-1] - seen[offsets[:-1]][row_of]
        return (before & 1).astype(bool), (seen[offsets[1:]] - seen[offsets[:-1]]) % 2 == 1

    dq, sq = kinds == _DQ, kinds == _SQ
    if not (dq.any() or sq.any()):
        return np.zeros(n, bool)
    in_dq, odd_dq = parity(dq)
    outer = sq & ~in_dq
    in_sq, odd_sq = parity(outer)
    first = np.zeros(n, bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    before = np.concatenate([[_SEP], kinds[:-1]])
    before[first] = _SEP
    last = np.zeros(n, bool)
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    after = np.concatenate([kinds[1:], [_SEP]])
    after[last] = _SEP
    odd = np.zeros(n, bool)
    for mark, inside, own in ((dq, in_dq, _DQ), (outer, in_sq, _SQ)):
        odd |= mark & ~inside & ~((before == _SEP) | (before == _BLANK) | (before == _EQ) | (before == own))
        odd |= mark & inside & ~((after == _SEP) | (after == _BLANK) | (after == own))
    odd |= dq & in_sq
    # a quote after a blank may stand within a bare value: before it in its item may be a key alone, one = and no other quote
    quoted = in_dq | in_sq
    free = ~quoted
    opening = np.flatnonzero((dq & ~in_dq | outer & ~in_sq) & ~((before == _DQ) | (before == _SQ)))
    if len(opening):
        stop = np.flatnonzero((kinds == _SEP) & free | first)
        item = stop[np.searchsorted(stop, opening, "right") - 1]
        is_word = free & ((kinds == _OTHER) | (kinds == _DQ) | (kinds == _SQ))
        word = is_word & ~np.concatenate([[False], is_word[:-1] & ~first[1:]]) if n > 1 else is_word
        words = np.concatenate([[0], np.cumsum(word & ~dq & ~outer)])
        equals = np.concatenate([[0], np.cumsum(free & (kinds == _EQ))])
        earlier = np.arange(len(opening)) - np.searchsorted(opening, item)
        odd[opening] |= (words[opening] - words[item] > 1) | (equals[opening] - equals[item] > 1) | (earlier > 0)
        begins = _at(np.flatnonzero((kinds != _BLANK) & (kinds != _SEP)), item, opening)
        odd[opening] |= kinds[begins] == _EQ
    wrong = odd_dq | odd_sq
    wrong[row_of[odd]] = True
    rows = np.flatnonzero(wrong)
    if len(rows):
        quoted[wrong[row_of]] = False
        _exact_quoted(kinds, offsets, rows, quoted)
    return quoted


def _gather(data: np.ndarray, keep: np.ndarray, kept: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The slices start..end of the data, without bytes that aren't kept, as a string array."""
    n = len(data)
    cover = np.cumsum(np.bincount(start, minlength=n + 1) - np.bincount(end, minlength=n + 1))[:n] > 0
    offsets = np.concatenate([[0], np.cumsum(kept[end] - kept[start])]).astype(np.int32)
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data[cover & keep]))


def split_items(texts: pa.Array, lone_key: str | None) -> tuple[pa.ListArray, pa.ListArray]:
    """The keys and the values of the items of each text, as two list arrays; texts hold neither nulls nor fields to skip."""
    data, offsets = _buffers(texts)
    n, rows = len(data), len(texts)
    kinds = _CLASS[data]
    row_of = np.repeat(np.arange(rows), np.diff(offsets))
    quoted = _quoted(kinds, offsets, row_of)

    cuts = np.flatnonzero((kinds == _SEP) & ~quoted)
    start = np.sort(np.concatenate([offsets[:-1], cuts + 1]), kind="stable")
    end = np.sort(np.concatenate([cuts, offsets[1:]]), kind="stable")
    of = np.repeat(np.arange(rows), np.bincount(row_of[cuts], minlength=rows) + 1)
    solid = np.flatnonzero(kinds != _BLANK)
    start = _at(solid, start, end)
    some = start < end
    start, end, of = start[some], end[some], of[some]
    end = solid[np.searchsorted(solid, end) - 1] + 1

    head = kinds[start]
    by_quote = (head == _DQ) | (head == _SQ)
    key_end = _at(np.flatnonzero(((kinds == _BLANK) | (kinds == _EQ)) & ~quoted), start, end)
    key_end[by_quote] = end[by_quote]
    value = _at(solid, key_end, end)
    more = value < end
    equals = more.copy()
    equals[more] = kinds[value[more]] == _EQ
    value[equals] = _at(solid, value[equals] + 1, end[equals])
    lone = key_end == end
    value_end, key_start = end.copy(), start.copy()
    if lone_key is not None:
        value[lone] = start[lone]
        key_end[lone] = start[lone]

    keep = np.ones(n, bool)

    def bare(s: np.ndarray, e: np.ndarray) -> None:
        """Take away the quotes around slices, and the second of doubled quotes in them."""
        bounds = kinds[np.minimum(s, n - 1)]
        for own in (_DQ, _SQ):
            long = np.flatnonzero((e - s >= 2) & (bounds == own))
            long = long[(kinds[s[long]] == own) & (kinds[e[long] - 1] == own)]
            s[long] += 1
            e[long] -= 1
            if len(long):
                inner = np.cumsum(np.bincount(s[long], minlength=n + 1) - np.bincount(e[long], minlength=n + 1))[:n] > 0
                marks = np.flatnonzero(inner & (kinds == own))
                if len(marks):
                    seen = np.searchsorted(s[long], marks, "right") - 1
                    rank = np.arange(len(marks)) - np.searchsorted(marks, s[long])[seen]
                    second = rank % 2 == 1
                    twin = np.append((np.diff(marks) == 1) & second[1:], False)
                    broken = np.zeros(len(long), bool)  # a mark alone: the quotes don't enclose the whole
                    broken[seen[~second & ~twin]] = True
                    s[long[broken]] -= 1
                    e[long[broken]] += 1
                    keep[marks[second & ~broken[seen]]] = False

    bare(value, value_end)
    if lone_key is None:
        quoted_key = by_quote & lone
        s, e = key_start[quoted_key], key_end[quoted_key]
        bare(s, e)
        key_start[quoted_key], key_end[quoted_key] = s, e
    kept = np.concatenate([[0], np.cumsum(keep)])
    keys = _gather(data, keep, kept, key_start, key_end)
    if lone_key is not None:
        keys = pc.if_else(pa.array(lone), pa.scalar(lone_key, pa.string()), keys)
    values = _gather(data, keep, kept, value, value_end)
    places = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=rows))]).astype(np.int32))
    return pa.ListArray.from_arrays(places, keys), pa.ListArray.from_arrays(places, values)


def unpack_fields(df: DataFrame, row_id: str, fields: dict[str, str | None]) -> DataFrame:
    """Rows (row_id, field, pos, attr_key, attr_value): one for each item of each of the fields.

    ``fields`` maps a column to the key that an item without a key gets, or to None: then an item of one word is a key with
    the value ''. Items are separated by semicolons, commas, vertical bars or tabs, in any number; an item is a key and a
    value with blanks or one ``=`` (or both) between them; a value may stand in single or double quotes, which then may
    hold separators and, doubled, themselves. A quote that doesn't open a value is an ordinary character, and one that is
    never closed goes, as it is written, to the end of the field. pos counts the items of a field from 1. Null, blank and
    ``.`` fields hold no items; repeated rows give their items each; a null row_id is kept; an empty table gives no rows.

    It is a narrow step: no shuffle, one pass over the Arrow buffers of each batch, in blocks of at most ``BLOCK`` bytes
    (or of one row, if that is longer).
    """
    source = pick(df, _row=row_id, **{f"_f{i}": c for i, c in enumerate(fields)})
    id_type = source.schema["_row"].dataType
    named = list(fields.items())

    def blocks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.Array, pa.Array]]:
        texts = batch.column(column)
        trimmed = pc.utf8_trim(texts, " ")
        used = pc.and_(pc.not_equal(trimmed, ""), pc.not_equal(trimmed, "."))
        used = pc.fill_null(used, False)
        ids, texts = batch.column(0).filter(used), texts.filter(used)
        sizes = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))])
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + BLOCK, "right")) - 1)
            part = texts.slice(at, to - at)
            yield ids.slice(at, to - at), part
            at = to

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (field, lone_key) in enumerate(named):
                for ids, texts in blocks(batch, i + 1):
                    keys, values = split_items(texts, lone_key)
                    parents = pc.list_parent_indices(keys)
                    first = np.asarray(keys.offsets)[np.asarray(parents)]
                    count = len(parents)
                    pos = np.arange(count, dtype=np.int64) - first + 1
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(parents), pa.array([field] * count, pa.string()) if count < 1 else pa.DictionaryArray.from_arrays(np.zeros(count, np.int32), pa.array([field])).cast(pa.string()), pa.array(pos), keys.flatten(), values.flatten()],
                        ["_row", "field", "pos", "attr_key", "attr_value"],
                    )

    out = source.mapInArrow(scan, f"_row {id_type.simpleString()}, field string, pos bigint, attr_key string, attr_value string")
    return out.select(F.col("_row").alias(row_id), "field", "pos", "attr_key", "attr_value")
