"""Figures of texts: raw figures of their lines for the rules that tell kinds apart, and plain statistics."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.session import pick

#: Bytes of text that are measured at once.
BLOCK = 1 << 19

#: Articles, pronouns, prepositions, conjunctions and auxiliary verbs of English, German, French, Spanish and Russian; a choice of this library.
#: Only the statistic ``common_share`` looks at them, the kinds don't.
COMMON_WORDS = (
    "the of and to a in is it you that he was for on are with as i his they be at this have from or by but not what all were we when can "
    "der die das und ist nicht ein eine ich sie er es zu mit auf für von dem den im wir auch "
    "le la les de des et est un une que qui dans pour pas sur il elle au ne "
    "el los las y en por con no se lo para su como del al "
    "и в не на что он с как это по но из у за от к мы она они"
).split()

#: The lines on commit, author and date above the message; those of a mail hold the subject too.
HEADER = re.compile(r"\s*(?:commit [^\n]*\n(?:[A-Z][\w-]*: [^\n]*\n)+\s*|(?P<mail>From [^\n]*\n(?:[A-Z][\w-]*: [^\n]*\n)+)|# HG changeset patch\n(?:# [^\n]*\n)*)?")
#: Characters of the longest first line that is taken for a subject.
SUBJECT = 200

# classes of characters; what stands before DIGIT is blank
_SPACE, _TAB, _NEWLINE, _DIGIT, _LOW_V, _LOW_C, _UP_V, _UP_C, _LETTER, _MARK, _DOT, _STOP, _COMMA, _SEMI, _COLON, _PIPE, _SLASH, _UNDER, _DASH, _BRACKET, _OPERATOR, _QUOTE, _POINT, _ODD = range(24)
_CLASSES = 24
_ASCII = {" ": _SPACE, "\t": _TAB, "\n": _NEWLINE, ".": _DOT, "!": _STOP, "?": _STOP, ",": _COMMA, ";": _SEMI, ":": _COLON, "|": _PIPE, "/": _SLASH, "\\": _SLASH, "_": _UNDER, "-": _DASH, "<": _BRACKET, ">": _BRACKET}
_ASCII |= dict.fromkeys("=+*&%$@#^~", _OPERATOR) | dict.fromkeys("'\"`", _QUOTE)
_VOWELS = frozenset("aeiouyаеёиоуыэюяіїєαεηιουω")
#: Scripts that one text of an East Asian language mixes.
_EAST = ("CJK", "HIRAGANA", "KATAKANA", "KATAKANA-HIRAGANA", "HANGUL", "BOPOMOFO", "IDEOGRAPHIC", "FULLWIDTH", "HALFWIDTH")

#: What the rules look at: figures of a text's lines, as their mean weighted by the characters of each line.
FEATURES = [
    "letters", "digits", "brackets", "operators", "quotes", "joints", "pauses", "odd", "dashes", "turns", "script_turns", "clusters", "runs", "same_words", "aligned", "gaps",
    "tabs_again", "pipes_again", "semicolons_again", "commas_again", "length_again", "first_letter", "first_digit", "ends_stop", "ends_pause", "ends_bracket", "ends_word", "indent",
    "plain_words", "number_words", "letters_near",
]
#: Further figures that only describe a text.
DESCRIBED = ["lines", "mean_words", "word_length", "signs", "stop_lines", "common", "distinct_words"]


@cache
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The class, script (0 for none) and lower case of each code point, by the Unicode properties Python knows."""
    kind = np.full(0x110000, _ODD, np.uint8)
    script = np.zeros(0x110000, np.uint8)
    lower = np.arange(0x110000, dtype=np.uint32)
    kind[0x20000:0x40000] = _LETTER
    scripts: dict[str, int] = {}
    for code in range(0x20000):
        ch = chr(code)
        g = unicodedata.category(ch)
        if ch in _ASCII:
            kind[code] = _ASCII[ch]
        elif g[0] == "L":
            name = unicodedata.name(ch, "").split(" ")[0]
            script[code] = scripts.setdefault("EAST" if name in _EAST else name, len(scripts) % 250 + 1)
            low = ch.lower()
            if len(low) == 1:
                lower[code] = ord(low)
            kind[code] = _LETTER
            if name in ("LATIN", "CYRILLIC", "GREEK") and g in ("Lu", "Ll", "Lt"):
                vowel = unicodedata.normalize("NFD", low)[0] in _VOWELS
                kind[code] = (_LOW_V if vowel else _LOW_C) if g == "Ll" else (_UP_V if vowel else _UP_C)
        elif g[0] in "MNZ":
            kind[code] = {"M": _MARK, "N": _DIGIT, "Z": _SPACE}[g[0]]
        elif g == "Pd":
            kind[code] = _DASH
        elif g in ("Ps", "Pe"):
            kind[code] = _BRACKET
        elif g in ("Pi", "Pf"):
            kind[code] = _QUOTE
        elif g[0] == "P":
            name = unicodedata.name(ch, "")
            kind[code] = _STOP if any(x in name for x in ("FULL STOP", "QUESTION MARK", "EXCLAMATION MARK", "DANDA")) else _COMMA if "COMMA" in name else _POINT
    return kind, script, lower


def _is_letter(kind: np.ndarray) -> np.ndarray:
    return (kind >= _LOW_V) & (kind <= _MARK)


@cache
def _turns() -> np.ndarray:
    """Of two classes, whether letters written as usual don't follow each other so: small before great, letter and digit."""
    i, j = np.meshgrid(np.arange(_CLASSES), np.arange(_CLASSES), indexing="ij")
    low, up = (i == _LOW_V) | (i == _LOW_C), (j == _UP_V) | (j == _UP_C)
    return low & up | _is_letter(i) & (j == _DIGIT) | (i == _DIGIT) & _is_letter(j)


_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base to the power 0..n-1, modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK), base, np.uint64)
        have[0] = 1
        _powers[base] = np.multiply.accumulate(have)
    return _powers[base][:n]


def _word_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Equal numbers for equal slices: the polynomial of their code points, from sums over the whole."""
    n = len(codes)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * _power(_BASE, n))])
    return (sums[end] - sums[start]) * _power(pow(_BASE, -1, 1 << 64), n)[start]


@cache
def _common_hashes() -> np.ndarray:
    text = " ".join(COMMON_WORDS)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ends = np.append(np.flatnonzero(codes == 32), len(codes))
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.unique(_word_hashes(codes.astype(np.uint64), starts, ends))


def body(text: str) -> str:
    """The text below its header and subject, with one kind of line end. A first line that is long or has nothing below it stays."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    head = HEADER.match(text)
    rest = text[head.end() :]
    subject, _, below = rest.partition("\n")
    return below if not head["mail"] and len(subject) <= SUBJECT and below.strip() else rest


_DIFF = re.compile(r"(?m)^(?=diff --git )")
_HUNK = re.compile(r"(?m)^@@ .*\n")
_SIGN = re.compile(r"(?m)^[-+ ]")
_META = re.compile(
    r"(?m)^(?:diff --git .*|index [0-9a-f]+\.\..*|(?:---|\+\+\+) (?:[ab]/.*|/dev/null)|Binary files .*|GIT binary patch|literal \d+"
    r"|(?:new|deleted) file mode .*|(?:old|new) mode .*|similarity index .*|rename (?:from|to) .*)(?:\n|\Z)"
)


def without_diff(text: str) -> str:
    """The text without the lines that only frame a diff, and the lines of its hunks without their first sign."""
    out = []
    for part in _DIFF.split(text):
        head, *hunks = _HUNK.split(part)
        out.append(_META.sub("", head))
        out += [_SIGN.sub("", h) for h in hunks]
    return "".join(out)


def measure(bodies: list[str]) -> np.ndarray:
    """A row of ``FEATURES`` and ``DESCRIBED`` for each text, zeros for one without a letter or sign.

    Of a line: shares of its characters that aren't blank (letters, digits, brackets, operators, quotes, slashes and underscores, pauses such as
    commas, odd characters such as controls, dashes, turns from small to great letters or between letters and digits, the third and further of equal
    characters), of its letters (changes of script inside words, the fourth and further consonant in a row), of its words (those that occur again, those that begin or end below or
    above a word's, wide gaps, words of letters or of figures only); how many tabs, bars, semicolons and commas it has if the line before or behind
    has as many; how far its length is from theirs; what it begins and ends with; its indent and the share of letters around it. No word, language or format is looked up: the rules are to find out what tells the kinds.
    """
    n_docs = len(bodies)
    out = np.zeros((n_docs, len(FEATURES) + len(DESCRIBED)))
    clean = [without_diff(b) for b in bodies]
    codes = np.frombuffer(("\n".join(clean) + "\n").encode("utf-32-le", "replace"), np.uint32)
    kinds, scripts, lower = _characters()
    k = kinds[codes]
    stops = np.flatnonzero(k == _NEWLINE)
    starts = np.concatenate([[0], stops[:-1] + 1])
    n_lines = len(stops)
    line = np.repeat(np.arange(n_lines), stops - starts + 1)
    ink_at = k > _NEWLINE
    edge = np.diff(np.concatenate([[0], ink_at.view(np.int8), [0]]))
    w_start, w_end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(w_start):
        return out

    # lines that aren't blank
    words = np.bincount(line[w_start], minlength=n_lines)
    full = np.flatnonzero(words)
    m = len(full)
    doc = np.searchsorted(np.cumsum([len(b) + 1 for b in clean]), starts, "right")[full]
    near = doc[1:] == doc[:-1]
    behind, ahead = np.concatenate([[False], near]), np.concatenate([near, [False]])
    count = np.bincount(line * _CLASSES + k, minlength=n_lines * _CLASSES).reshape(n_lines, _CLASSES)[full].astype(np.float64)
    ink = count[:, _DIGIT:].sum(1)
    letters = count[:, _LOW_V : _MARK + 1].sum(1)
    some_letters = np.maximum(letters, 1)
    words = words[full].astype(np.float64)

    def per_line(mask: np.ndarray) -> np.ndarray:
        return np.bincount(line[: len(mask)][mask], minlength=n_lines)[full]

    # words
    place = np.zeros(n_lines, np.int64)
    place[full] = np.arange(m)
    w_line = place[line[w_start]]
    w_first = np.searchsorted(w_line, np.arange(m))
    w_last = np.append(w_first[1:], len(w_line)) - 1
    letter_at = _is_letter(k)
    seen_letters = np.concatenate([[0], np.cumsum(letter_at, dtype=np.int32)])
    seen_digits = np.concatenate([[0], np.cumsum(k == _DIGIT, dtype=np.int32)])
    w_letters, w_digits, w_size = seen_letters[w_end] - seen_letters[w_start], seen_digits[w_end] - seen_digits[w_start], w_end - w_start
    small = lower[codes].astype(np.uint64)
    w_hash = _word_hashes(small, w_start, w_end)

    def of_words(mask: np.ndarray) -> np.ndarray:
        return np.bincount(w_line, mask, m) / words

    def distinct(group: np.ndarray, size: int) -> np.ndarray:
        order = np.lexsort((w_hash, group))
        g, h = group[order], w_hash[order]
        return np.bincount(g[np.concatenate([[True], (g[1:] != g[:-1]) | (h[1:] != h[:-1])])], minlength=size)

    def in_column(at: np.ndarray) -> np.ndarray:
        """The share of the words behind the first that start or end where one of the line before or behind does."""
        key = w_line * 4096 + np.minimum(at - starts[full][w_line], 4095)
        inner = np.ones(len(key), bool)
        inner[w_first] = False
        own, of = key[inner], w_line[inner]
        there = lambda x: key[np.minimum(np.searchsorted(key, x), len(key) - 1)] == x
        return np.bincount(of, there(own - 4096) & behind[of] | there(own + 4096) & ahead[of], m) / np.maximum(words - 1, 1)

    # signs next to each other
    consonant = (k == _LOW_C) | (k == _UP_C)
    same = (codes[1:] == codes[:-1]) & ink_at[1:]
    script = scripts[codes]
    blank = k <= _TAB
    first, last = w_start[w_first], w_end[w_last] - 1
    indent = first - starts[full]
    wide_gaps = per_line(blank[:-2] & blank[1:-1] & ink_at[2:]) - (indent >= 2)

    def again(x: np.ndarray) -> np.ndarray:
        """The number where the line before or behind has the same, else 0."""
        equal = (x[1:] == x[:-1]) & near
        return np.where(np.concatenate([[False], equal]) | np.concatenate([equal, [False]]), x, 0)

    apart = np.where(near, np.abs(ink[1:] - ink[:-1]) / np.maximum(ink[1:], ink[:-1]), 1)
    share = letters / ink
    around = np.concatenate([[0], np.where(near, share[:-1], 0)]) + np.concatenate([np.where(near, share[1:], 0), [0]])
    n_around = behind.astype(np.float64) + ahead
    head, tail = k[first], k[last]
    ends_stop = (tail == _DOT) | (tail == _STOP)
    figures = {
        "letters": share, "digits": count[:, _DIGIT] / ink, "brackets": count[:, _BRACKET] / ink, "operators": count[:, _OPERATOR] / ink, "quotes": count[:, _QUOTE] / ink,
        "joints": (count[:, _SLASH] + count[:, _UNDER]) / ink, "pauses": count[:, _COMMA : _COLON + 1].sum(1) / ink, "odd": count[:, _ODD] / ink, "dashes": count[:, _DASH] / ink,
        "turns": per_line(_turns()[k[:-1], k[1:]]) / ink,
        "script_turns": per_line((script[:-1] != script[1:]) & (script[:-1] > 0) & (script[1:] > 0)) / some_letters,
        "clusters": per_line(consonant[:-3] & consonant[1:-2] & consonant[2:-1] & consonant[3:]) / some_letters if len(k) > 3 else np.zeros(m),
        "runs": per_line(same[1:] & same[:-1]) / ink,
        "same_words": 1 - distinct(w_line, m) / words,
        "aligned": np.maximum(in_column(w_start), in_column(w_end)), "gaps": np.maximum(wide_gaps, 0) / words,
        "tabs_again": again(count[:, _TAB]), "pipes_again": again(count[:, _PIPE]), "semicolons_again": again(count[:, _SEMI]), "commas_again": again(count[:, _COMMA]),
        "length_again": np.minimum(np.concatenate([[1], apart]), np.concatenate([apart, [1]])),
        "first_letter": _is_letter(head), "first_digit": head == _DIGIT,
        "ends_stop": ends_stop, "ends_pause": (tail >= _COMMA) & (tail <= _COLON), "ends_bracket": tail == _BRACKET, "ends_word": _is_letter(tail) | (tail == _DIGIT), "indent": indent,
        "plain_words": of_words((w_letters >= w_size - 1) & (w_digits == 0) & (w_letters > 0)), "number_words": of_words((w_digits > 0) & (w_letters == 0)),
        "letters_near": np.where(n_around > 0, around / np.maximum(n_around, 1), share),
    }
    held, cut = np.unique(doc, return_index=True)
    total = np.add.reduceat(ink, cut)
    for j, f in enumerate(FEATURES):
        out[held, j] = np.add.reduceat(ink * figures[f], cut) / total

    # descriptions: words without the signs around them count as common or not
    n_words, n_held = np.add.reduceat(words, cut), np.diff(np.append(cut, m))
    at = np.flatnonzero(letter_at)
    lettered = w_letters > 0
    from_ = at[np.searchsorted(at, w_start[lettered])]
    to = at[np.searchsorted(at, w_end[lettered]) - 1] + 1
    known = np.isin(_word_hashes(small, from_, to), _common_hashes())
    n_known = np.bincount(doc[w_line[lettered]], known, n_docs)[held]
    signs = np.add.reduceat(count[:, _DOT:_ODD].sum(1), cut)
    described = [n_held, n_words / n_held, total / n_words, signs / total, np.add.reduceat(ink * ends_stop, cut) / total, n_known / n_words, distinct(doc[w_line], n_docs)[held] / n_words]
    out[held, len(FEATURES) :] = np.stack(described, 1)
    return out


def text_features(df: DataFrame, keep: list[str], text: str = "text", described: bool = False) -> DataFrame:
    """The columns ``keep`` and the ``FEATURES`` of each text's body, with ``described`` also ``DESCRIBED``; 0 for null, empty and blank texts.

    A narrow step over Arrow batches, in blocks of about ``BLOCK`` bytes; texts are measured whole. Every row has its row.
    """
    rows = pick(df, **{f"_k{i}": c for i, c in enumerate(keep)}, _text=text)
    types = [rows.schema[f"_k{i}"].dataType for i in range(len(keep))]
    names = [*FEATURES, *(DESCRIBED if described else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(len(keep)), "")
            sizes = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))])
            at = 0
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + BLOCK, "right")) - 1)
                found = measure([body(t) for t in texts.slice(at, to - at).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).slice(at, to - at) for i in range(len(keep))], *[pa.array(np.ascontiguousarray(found[:, j])) for j in range(len(names))]],
                    [*[f"_k{i}" for i in range(len(keep))], *names],
                )
                at = to

    schema = T.StructType([*[T.StructField(f"_k{i}", t) for i, t in enumerate(types)], *[T.StructField(f, T.DoubleType()) for f in names]])
    return rows.mapInArrow(run, schema).select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], *names)


def _common_count(words, known):
    bare = F.transform(words, lambda w: F.lower(F.btrim(w, F.lit(".,;:!?()\"'`*"))))
    return F.size(F.filter(bare, lambda w: w.isin(known)))


def text_stats(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and, of each whole text, n_words, mean_word_length, symbol_ratio, end_punct_share and common_share.

    Words are what stands between blanks, tabs and line ends; symbols are the ASCII signs that are neither letters nor digits; of the lines
    that aren't blank those count that end in ``. ! ? : ;`` before blanks; common words are ``COMMON_WORDS``, regardless of case and of
    signs around them. Shares are rounded to six places, and 0 where there is nothing to divide by; a null text counts as an empty one. Built-in
    functions only.
    """
    rows = pick(df, **{f"_k{i}": c for i, c in enumerate(keep)}, _text=text)
    t = F.coalesce("_text", F.lit(""))
    words = F.filter(F.split(t, "[ \t\n\r]+"), lambda w: w != "")
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.regexp_replace(x, "[ \t\r]+$", "")), lambda x: x != "")
    rows = rows.select("*", words.alias("w"), lines.alias("l"), t.alias("t"))

    def ratio(part, whole):
        return F.when(whole > 0, F.round(part / whole, 6)).otherwise(F.lit(0.0))

    n = F.size("w")
    return rows.select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)],
        n.cast("bigint").alias("n_words"),
        ratio(F.aggregate("w", F.lit(0), lambda a, w: a + F.length(w)), n).alias("mean_word_length"),
        ratio(F.length("t") - F.length(F.regexp_replace("t", r"[!-/:-@\[-`{-~]", "")), F.length("t")).alias("symbol_ratio"),
        ratio(F.size(F.filter("l", lambda x: x.substr(F.lit(-1), F.lit(1)).isin(list(".!?:;")))), F.size("l")).alias("end_punct_share"),
        ratio(_common_count(F.col("w"), list(COMMON_WORDS)), n).alias("common_share"),
    )
