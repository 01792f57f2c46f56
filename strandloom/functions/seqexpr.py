"""Column expressions on biological sequences: built-in functions only, so they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the standard genetic code, codons in the order TCAG x TCAG x TCAG
_AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
_BASES = "TCAG"
CODONS = {a + b + c: _AMINO[16 * i + 4 * j + k] for i, a in enumerate(_BASES) for j, b in enumerate(_BASES) for k, c in enumerate(_BASES)}

# fixed values: main properties of the amino acids
AA_PROPERTY = {
    "polar": "STNQC", "basic pos charge": "KRH", "stop": "*", "non polar": "AVLIMGP", "acidic neg charge": "DE", "non polar aromtic": "WFY",
}


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def revcomp(seq: Column | str, reverse: bool = True, complement: bool = True) -> Column:
    """The reverse complement in upper case; letters other than ACGT become N. Only reversed, letters stay as they are."""
    s = _col(seq)
    if complement:
        s = F.translate(F.regexp_replace(F.upper(s), "[^ACGT]", "N"), "ACGT", "TGCA")
    return F.reverse(s) if reverse else s


def translate_dna(seq: Column | str) -> Column:
    """Amino acids of the whole codons of the sequence, X for codons with other letters than ACGT; null stays null, '' gives ''."""
    s = F.upper(F.translate(_col(seq), "Uu", "TT"))
    codes = F.create_map(*[F.lit(x) for kv in CODONS.items() for x in kv])
    codons = F.regexp_extract_all(s, F.lit("(?s)..."), F.lit(0))  # one walk over the letters
    made = F.array_join(F.transform(codons, lambda c: F.coalesce(F.try_element_at(codes, c), F.lit("X"))), "")
    return F.when(F.length(s) >= 3, made).when(s.isNotNull(), F.lit(""))


def phred(qual: Column | str, offset: int = 33) -> Column:
    """The quality scores of a quality string as an array; '' gives an empty array."""
    return F.transform(F.filter(F.split(_col(qual), ""), lambda c: c != ""), lambda c: F.ascii(c) - offset)


def quality_stats(qual: Column | str, below: int = 30) -> list[Column]:
    """min_qual, mean_qual and n_below of a quality string; null where it is empty or null."""
    q = _col(qual)
    letters = F.split(q, "")  # one walk over the letters; the rest works on the string
    some = F.length(q) > 0
    total = F.aggregate(letters, F.lit(0), lambda a, x: a + F.ascii(x)) - 33 * F.length(q)
    low = f"[^{chr(33 + below)}-~]"
    return [
        F.when(some, F.ascii(F.array_min(F.array_compact(F.array_remove(letters, "")))) - 33).alias("min_qual"),
        F.when(some, total / F.length(q)).alias("mean_qual"),
        F.when(some, F.length(q) - F.length(F.regexp_replace(q, low, ""))).alias("n_below"),
    ]


def share_below(qual: Column | str, below: int = 30) -> Column:
    """Share of bases whose quality is below; null for an empty quality string."""
    # what is left without the low characters has the length of the rest
    good = f"[^{chr(33 + below)}-~]"
    q = _col(qual)
    return F.when(F.length(q) > 0, 1 - F.length(F.regexp_replace(q, good, "")) / F.length(q))


def wrap(seq: Column | str, width: int = 60) -> Column:
    """The sequence in lines of the width."""
    return F.regexp_replace(_col(seq), f"(.{{{width}}})(?=.)", "$1\n")


def leading(seq: Column | str, letter: str = "N") -> Column:
    s = _col(seq)
    return F.length(s) - F.length(F.ltrim(s, F.lit(letter)))


def trailing(seq: Column | str, letter: str = "N") -> Column:
    s = _col(seq)
    return F.length(s) - F.length(F.rtrim(s, F.lit(letter)))


def guess_type(seq: Column | str) -> Column:
    """Aggregate: DNA, RNA or AA, the first of these whose letters all sequences keep to; null if none fits or there is none."""
    s = F.upper(_col(seq))
    return (
        F.when(F.bool_and(s.rlike(r"\A[ACGTMRWSYKVHDBN+.-]*\z")), "DNA")
        .when(F.bool_and(s.rlike(r"\A[ACGUMRWSYKVHDBN+.-]*\z")), "RNA")
        .when(F.bool_and(s.rlike(r"\A[A-Z*+.-]*\z")), "AA")
    )


def longest_plain_run(seq: Column | str, ambiguous: str = "MRWSYKVHDBN") -> Column:
    """Struct (run, first, last): the longest run without ambiguity codes, the first of equals, with its place."""
    s = _col(seq)
    parts = F.split(s, f"[{ambiguous}]")
    lengths = F.transform(parts, lambda p: F.length(p))
    longest = F.array_max(lengths)
    at = F.array_position(lengths, longest).cast("int")
    before = F.aggregate(F.slice(lengths, F.lit(1), at - 1), F.lit(0), lambda a, x: a + x + 1)
    return F.struct(F.element_at(parts, at).alias("run"), (before + 1).alias("first"), (before + longest).alias("last"))


def hamming(a: Column, b: Column) -> Column:
    """Differing places of two strings of one length."""
    return F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(1)))


def paste(*parts: Column, sep: str = "_") -> Column:
    """Parts joined with ``NA`` for null ones."""
    return F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("NA")) for p in parts])


def any_false(condition: Column) -> Column:
    """Aggregate: false if any is false, true otherwise, also when all are null."""
    return F.coalesce(F.bool_and(condition), F.lit(True))


def match_symbols(seq: Column | str) -> Column:
    """A ruler for a sequence: blank on gaps, | on each fifth base and . on the others."""
    letters = F.split(_col(seq), "")
    step = F.aggregate(
        letters,
        F.struct(F.lit(0).alias("n"), F.lit("").alias("line")),
        lambda a, c: F.struct(
            (a["n"] + F.when(c == "-", 0).otherwise(1)).alias("n"),
            F.concat(a["line"], F.when(c == "-", " ").when((a["n"] + 1) % 5 == 0, "|").otherwise(".")).alias("line"),
        ),
    )
    return F.when(F.length(_col(seq)) > 0, step["line"]).when(_col(seq).isNotNull(), F.lit(""))


def dots_for_matches(pattern: Column, subject: Column) -> Column:
    """The pattern with a dot wherever it has the subject's letter."""
    pairs = F.zip_with(F.split(pattern, ""), F.split(subject, ""), lambda p, s: F.when((p == s) & (p != ""), ".").otherwise(F.coalesce(p, F.lit(""))))
    return F.array_join(pairs, "")


def pad(name: Column, width: Column | int) -> Column:
    """The name filled with blanks to the width."""
    return F.concat(name, F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(width) - F.length(name))))


def aa_property(letter: Column) -> Column:
    """The main property of an amino acid; null for other letters."""
    out = F.lit(None).cast("string")
    for name, letters in AA_PROPERTY.items():
        out = F.when(F.upper(letter).isin(list(letters)), name).otherwise(out)
    return out


def random_dna(length: int, seed: int, letters: str = "ATCG") -> Column:
    """A string of random bases, the same for the same seed and partitioning."""
    parts = [F.element_at(F.array(*[F.lit(c) for c in letters]), (F.floor(F.rand(seed + i) * len(letters)) + 1).cast("int")) for i in range(length)]
    return F.concat(*parts)


def parse_region(query: Column) -> Column:
    """Struct (seqname, first, last) of ``chr2:86,784,610-86,808,396``, ``chr2 100 200`` or ``2,1000,30000``; nulls where it doesn't fit."""
    q = F.trim(query)
    # thousands have three digits behind their comma; in the plain form with commas the numbers stand alone
    plain = F.regexp_replace(F.regexp_extract(q, r"\A([^,:\s]+),(\d+),(\d+)\z", 0), ",", " ")
    spelled = F.regexp_replace(F.regexp_replace(q, r"(?<=\d),(?=\d{3}(\D|\z))", ""), r"[:\s-]+", " ")
    parts = F.split(F.when(plain != "", plain).otherwise(spelled), " ")
    good = (F.size(parts) == 3) & F.get(parts, F.lit(1)).rlike(r"\A\d+\z") & F.get(parts, F.lit(2)).rlike(r"\A\d+\z")
    return F.struct(
        F.when(good, F.get(parts, F.lit(0))).alias("seqname"),
        F.when(good, F.get(parts, F.lit(1)).try_cast("bigint")).alias("first"),
        F.when(good, F.get(parts, F.lit(2)).try_cast("bigint")).alias("last"),
    )


def valid_letters(seq: Column | str, kind: str) -> Column:
    """Whether a sequence keeps to the letters of DNA, RNA or AA, ambiguity codes, gaps and masks included; null for null."""
    letters = {"DNA": "ACGTMRWSYKVHDBN+.-", "RNA": "ACGUMRWSYKVHDBN+.-", "AA": "ARNDCQEGHILKMFPSTWYVUOBJZX*+.-"}[kind]
    return F.upper(_col(seq)).rlike(rf"\A[{letters}]*\z")
