"""Encoding of a corpus by a public byte-level tokenizer, whose vocabulary file is given by its path."""

from __future__ import annotations

import base64
import heapq
import os
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.session import pick

#: Where the public vocabularies lie; a folder with this path must be on each executor.
TOKENIZERS = "/opt/tokenizers"
#: Bytes of text that are encoded at once.
BLOCK = 1 << 20
#: Pieces longer than this are not kept in the cache, and it is emptied when it holds so many.
LONGEST_CACHED, MOST_CACHED = 64, 400_000

_LETTER, _NUMBER, _SIGN, _SPACE = range(4)
# fixed values: the code points with the property White_Space
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of each code point: letter, number, white space or other sign."""
    table = np.full(sys.maxunicode + 1, _SIGN, np.uint8)
    major = np.frombuffer("".join(unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)).encode(), np.uint8)
    table[major == ord("L")] = _LETTER
    table[major == ord("N")] = _NUMBER
    table[_WHITE] = _SPACE
    return table


class Vocabulary:
    """Ranks of a file of lines ``base64(token) rank``, with a cache of pieces merged so far."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.cache: dict[bytes, list[int]] = {}

    def merged(self, piece: bytes) -> list[int]:
        """The ids of one piece: the pair of lowest rank, the leftmost of equals, is merged until none is in the vocabulary."""
        rank = self.rank
        if (whole := rank.get(piece)) is not None:
            return [whole]
        if len(piece) > 40:
            return self._merged_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        none = 1 << 60
        pairs = [rank.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs and (least := min(pairs)) < none:
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = rank.get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = rank.get(parts[i] + parts[i + 1], none)
        return [rank[p] for p in parts]

    def _merged_long(self, piece: bytes) -> list[int]:
        """The same with a heap over a linked list: n log n for long runs."""
        rank, n = self.rank, len(piece)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue
            end[i], alive[j], after[i] = stop, False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := rank.get(piece[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if before[i] >= 0 and (r := rank.get(piece[before[i] : stop])) is not None:
                heapq.heappush(heap, (r, before[i], stop))
        out, i = [], 0
        while i < n:
            out.append(rank[piece[i : end[i]]])
            i = after[i]
        return out

    def pieces(self, unique: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces, one after the other, and the number of each."""
        cache, found = self.cache, []
        for p in unique:
            ids = cache.get(p)
            if ids is None:
                ids = self.merged(p)
                if len(p) <= LONGEST_CACHED:
                    if len(cache) >= MOST_CACHED:
                        cache.clear()
                    cache[p] = ids
            found.append(ids)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((x for ids in found for x in ids), np.int32, int(counts.sum())), counts

    def token_bytes(self) -> dict[int, bytes]:
        return {v: k for k, v in self.rank.items()}


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, loaded once per worker. Where the path isn't there, the installed package of public tokenizers is asked for the file."""
    if not os.path.exists(path):
        try:
            import public_tokenizers
        except ImportError:
            raise FileNotFoundError(path) from None
        path = public_tokenizers.path(os.path.basename(path))
    return Vocabulary(path)


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The byte positions at which pieces begin in the concatenated UTF-8 texts, without a regular expression.

    Each code point has a class, and a code point's state (where the run of its class began) comes from its predecessor's
    by an associative scan, a running maximum of run starts. A run begins a piece, but for these: a blank before a run of letters,
    numbers or signs belongs to that piece; the last white space before such a run stands apart from those before it; an
    apostrophe alone before s, t, m, d, re, ve or ll forms a piece with them and cuts the letters behind.
    """
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    n = len(lead)
    if not n:
        return lead
    points = data if n == len(data) else np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = _classes()[points]
    fresh = np.zeros(n + 1, bool)  # first code point of a text
    first = np.searchsorted(lead, offsets)
    fresh[first] = True
    run = np.empty(n, bool)
    run[0] = True
    run[1:] = kind[1:] != kind[:-1]
    run |= fresh[:n]
    start = run.copy()
    solid = np.flatnonzero(run & (kind != _SPACE) & ~fresh[:n])
    solid = solid[kind[solid - 1] == _SPACE]
    start[solid - 1] = True
    start[solid] = points[solid - 1] != 0x20
    mark = np.flatnonzero((points == 0x27) & start)
    if len(mark):
        began = np.maximum.accumulate(np.where(run, np.arange(n), 0))
        ended = np.append(run[1:], True)
        mark = mark[(began[mark] == mark) & ended[mark] & (mark + 1 < n)]
        mark = mark[~fresh[mark + 1]]
        p1 = points[mark + 1]
        one = np.isin(p1, [ord(c) for c in "stmd"])
        p2 = np.where((mark + 2 < n) & ~fresh[np.minimum(mark + 2, n)], points[np.minimum(mark + 2, n - 1)], 0)
        two = ((p1 == ord("r")) | (p1 == ord("v"))) & (p2 == ord("e")) | (p1 == ord("l")) & (p2 == ord("l"))
        start[mark[one | two] + 1] = False
        behind = np.concatenate([mark[one] + 2, mark[two] + 3])
        start[behind[behind < n]] = True
    return lead[start]


def encode_block(texts: pa.Array, vocab: Vocabulary, with_ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts (none of them null) and the number in each; without ``with_ids`` only the numbers are made."""
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    nothing = np.zeros(0, np.int32)
    if offsets[0] == offsets[-1]:
        return nothing, np.zeros(len(texts), np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    starts = piece_starts(data, offsets)
    bounds = np.append(starts, len(data)).astype(np.int32)
    pieces = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
    flat, counts = vocab.pieces(pieces.dictionary.to_pylist())
    which = pieces.indices.to_numpy()
    each = counts[which]
    total = np.concatenate([[0], np.cumsum(each)])
    per_text = np.diff(total[np.searchsorted(starts, offsets)])
    if not with_ids:
        return nothing, per_text
    begins = np.cumsum(counts) - counts
    ids = flat[np.repeat(begins[which] - total[:-1], each) + np.arange(total[-1])]
    return ids, per_text


def token_ends(ids: np.ndarray, per_text: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The byte of its own text at which each token ends; lengths: bytes of each id."""
    ends = np.cumsum(lengths[ids])
    last = np.cumsum(per_text)
    before = np.concatenate([[0], ends])[last - per_text]
    return (ends - np.repeat(before, per_text)).astype(np.int32)


def _split(texts: pa.Array) -> Iterator[tuple[int, int]]:
    sizes = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))])
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + BLOCK, "right")) - 1)
        yield at, to
        at = to


def encode_texts(df: DataFrame, keep: list[str], text: str = "text", path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", out: str = "ids") -> DataFrame:
    """The columns ``keep`` of each row and its token ids, without special tokens: a narrow step over Arrow batches.

    ``out`` is ``ids`` (array of int), ``ids+ends`` (also ``ends``, the byte of the text at which each token ends, which lets
    slices of tokens be decoded) or ``count`` (``n_tokens`` bigint only). Empty and null texts have no ids: an empty array, 0 tokens.
    Each row, repeated ones too, has its row; an empty table gives none. Texts are encoded whole, whatever their length.
    """
    rows = pick(df, **{f"_k{i}": c for i, c in enumerate(keep)}, _text=text)
    types = [rows.schema[f"_k{i}"].dataType for i in range(len(keep))]
    ids_type = T.ArrayType(T.IntegerType())
    made = {"ids": [("ids", ids_type)], "ids+ends": [("ids", ids_type), ("ends", ids_type)], "count": [("n_tokens", T.LongType())]}[out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        lengths = None
        if out == "ids+ends":
            lengths = np.zeros(max(vocab.rank.values()) + 1, np.int64)
            for token, rank in vocab.rank.items():
                lengths[rank] = len(token)
        for batch in batches:
            texts = batch.column(len(keep))
            texts = pc.fill_null(texts, "")
            for at, to in _split(texts):
                ids, each = encode_block(texts.slice(at, to - at), vocab, out != "count")
                cells: list[pa.Array] = [batch.column(i).slice(at, to - at) for i in range(len(keep))]
                if out == "count":
                    cells.append(pa.array(each))
                else:
                    places = pa.array(np.concatenate([[0], np.cumsum(each)]).astype(np.int32))
                    cells.append(pa.ListArray.from_arrays(places, pa.array(ids)))
                    if out == "ids+ends":
                        cells.append(pa.ListArray.from_arrays(places, pa.array(token_ends(ids, each, lengths))))
                yield pa.RecordBatch.from_arrays(cells, [*[f"_k{i}" for i in range(len(keep))], *[c for c, _ in made]])

    schema = T.StructType([*[T.StructField(f"_k{i}", t) for i, t in enumerate(types)], *[T.StructField(c, t) for c, t in made]])
    done = rows.mapInArrow(run, schema)
    return done.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], *[c for c, _ in made])


def decode_ids(df: DataFrame, keep: list[str], ids: str = "ids", path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """The columns ``keep`` and ``text``, the text that the ids of each row stand for; null ids give null, no ids ''.

    Bytes that are no UTF-8 (a slice that cuts a character) become U+FFFD.
    """
    rows = pick(df, **{f"_k{i}": c for i, c in enumerate(keep)}, _ids=ids)
    types = [rows.schema[f"_k{i}"].dataType for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path).token_bytes()
        for batch in batches:
            texts = [None if row is None else b"".join(map(words.__getitem__, row)).decode("utf-8", "replace") for row in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], "text"])

    schema = T.StructType([*[T.StructField(f"_k{i}", t) for i, t in enumerate(types)], T.StructField("text", T.StringType())])
    return rows.mapInArrow(run, schema).select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "text")
