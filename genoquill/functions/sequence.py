"""Sequence expressions: alphabets, strands, splicing, motifs, codons and edit distances."""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: IUPAC letters and the nucleotides that they stand for; fixed values.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
_EXTENDED = "RYSWKMBDHV"
BASES = "TCAG"
#: Amino acids of the standard code for codons in the order of BASES; fixed values.
STANDARD = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
#: Codons in which numbered NCBI tables differ from table 1; fixed values.
TABLE_CHANGES = {
    1: {},
    2: {"AGA": "*", "AGG": "*", "ATA": "M", "TGA": "W"},
    3: {"ATA": "M", "CTT": "T", "CTC": "T", "CTA": "T", "CTG": "T", "TGA": "W"},
    4: {"TGA": "W"},
    5: {"AGA": "S", "AGG": "S", "ATA": "M", "TGA": "W"},
}
UNKNOWN_AMINO = "X"
A_BOX, B_BOX = "TGGCNNAGTGG", "GGTTCGANNCC"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalise(seq) -> Column:
    """Upper case, U to T, other IUPAC letters to N."""
    return F.translate(F.upper(_c(seq)), "U" + _EXTENDED, "T" + "N" * len(_EXTENDED))


def complement(seq) -> Column:
    return F.translate(_c(seq), "ACGT", "TGCA")


def reverse_complement(seq) -> Column:
    return F.reverse(complement(seq))


def stranded(seq, strand) -> Column:
    """Coding sequence of a linear one: as it is on +, reverse complement on -."""
    return F.when(_c(strand) == "-", reverse_complement(seq)).otherwise(_c(seq))


def subsequence(seq, lower, upper) -> Column:
    """[lower, upper) of seq, NULL where that isn't inside."""
    lo, up = _c(lower), _c(upper)
    return F.when((lo >= 0) & (lo <= up) & (up <= F.length(_c(seq))), F.substring(_c(seq), (lo + 1).cast("int"), (up - lo).cast("int")))


def splice(seq, exons) -> Column:
    """The exons (array of lower, upper) of seq, in order of their starts."""
    s = _c(seq)
    return F.array_join(F.transform(F.array_sort(_c(exons)), lambda x: F.substring(s, (x["lower"] + 1).cast("int"), (x["upper"] - x["lower"]).cast("int"))), "")


def modify_at(seq, pos, letter) -> Column:
    p = _c(pos)
    return F.when((p >= 0) & (p < F.length(_c(seq))), F.overlay(_c(seq), _c(letter), p + 1, F.lit(1)))


def delete_at(seq, pos, size) -> Column:
    p, n = _c(pos), _c(size)
    return F.when((p >= 0) & (p + n <= F.length(_c(seq))), F.overlay(_c(seq), F.lit(""), p + 1, n))


def insert_at(seq, pos, text) -> Column:
    p = _c(pos)
    return F.when((p >= 0) & (p <= F.length(_c(seq))), F.overlay(_c(seq), _c(text), p + 1, F.lit(0)))


def count_text(seq, text: str) -> Column:
    """Occurrences of text, without overlaps."""
    return ((F.length(_c(seq)) - F.length(F.replace(_c(seq), F.lit(text)))) / len(text)).cast("long")


def find_all(seq, text: str) -> Column:
    """Zero-based starts of text in seq, overlaps included."""
    s, k = _c(seq), len(text)
    return F.filter(F.sequence(F.lit(0), F.greatest(F.length(s) - k, F.lit(0))), lambda i: F.substring(s, i + 1, F.lit(k)) == text)


def kmer_count(seq, kmer: str, compat: bool = True) -> Column:
    """Windows of seq that equal kmer; with compat the last window isn't looked at."""
    s = _c(seq)
    all_ = F.regexp_count(s, F.lit(f"(?={re.escape(kmer)})"))
    return (all_ - F.endswith(s, F.lit(kmer)).cast("int") if compat else all_).cast("long")


def motif_regex(motif: str) -> str:
    """Regular expression of an IUPAC motif; a dot makes what stands before it optional."""
    return "".join("?" if c == "." else c if len(IUPAC.get(c, c)) == 1 else f"[{IUPAC[c]}]" for c in motif.upper())


def motif_count(seq, motif: str) -> Column:
    return F.regexp_count(_c(seq), F.lit(motif_regex(motif))).cast("long")


#: The two internal promoter motifs of polymerase III.
A_BOX, B_BOX = "TRGYNNANNNG", "GWTCRANNC"


def motif_intervals(seq, motif: str) -> Column:
    """array of (lower, upper): where an IUPAC motif stands, from left to right and without overlaps."""
    s, pattern = _c(seq), motif_regex(motif)
    between = F.split(s, pattern, -1)
    found = F.regexp_extract_all(s, F.lit(f"({pattern})"), F.lit(1))
    sizes = F.zip_with(between, found, lambda b, m: F.struct(F.length(b).alias("b"), F.length(m).alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<lower:int,upper:int>>").alias("out"))
    step = lambda a, x: F.struct((a["at"] + x["b"] + x["m"]).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + x["b"]).alias("lower"), (a["at"] + x["b"] + x["m"]).alias("upper")))).alias("out"))
    return F.aggregate(F.filter(sizes, lambda x: x["m"].isNotNull()), start, step, lambda a: a["out"])


def text_hash(text) -> Column:
    """CRC-32 of the UTF-8 text."""
    return F.crc32(_c(text).cast("binary"))


def edit_items(a: str, b: str) -> list[tuple[int, str, str]]:
    """(pos in a, ref, alt) of a least-cost alignment from a to b: changed, deleted and inserted letters, from left to right."""
    n, m = len(a), len(b)
    d = np.zeros((n + 1, m + 1), np.int32)
    d[:, 0], d[0, :] = np.arange(n + 1), np.arange(m + 1)
    letters = np.array([ord(c) for c in b], np.int64)
    for i in range(1, n + 1):
        d[i] = _row(d[i - 1], a[i - 1], letters, i)
    out, i, j = [], n, m
    while i or j:
        if i and j and d[i, j] == d[i - 1, j - 1] + (a[i - 1] != b[j - 1]):
            if a[i - 1] != b[j - 1]:
                out.append((i - 1, a[i - 1], b[j - 1]))
            i, j = i - 1, j - 1
        elif i and d[i, j] == d[i - 1, j] + 1:
            out.append((i - 1, a[i - 1], ""))
            i -= 1
        else:
            out.append((i, "", b[j - 1]))
            j -= 1
    return out[::-1]


@lru_cache(1 << 14)
def _items(a: str, b: str) -> list[tuple[int, str, str]]:
    """edit_items of the latest pairs of texts of a worker, each aligned once."""
    return edit_items(a, b)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("ref", T.StringType()), T.StructField("alt", T.StringType())])))
def edits(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else [{"pos": p, "ref": r, "alt": t} for p, r, t in _items(x, y)] for x, y in zip(a, b, strict=True)])


def cpg(seq) -> Column:
    """Occurrences of CG times 32 over the length."""
    s = _c(seq)
    return F.when(F.length(s) > 0, count_text(s, "CG") * 32.0 / F.length(s)).otherwise(0.0)


def entropy(seq, alphabet: str = "ACGT") -> Column:
    """Shannon entropy over the letters of alphabet, 1 if they are equally frequent."""
    s = _c(seq)
    n = [count_text(s, a) for a in alphabet]
    total = sum(n[1:], n[0])
    term = [F.when(x > 0, -(x / total) * F.ln(x / total)).otherwise(0.0) for x in n]
    return F.when(total > 0, sum(term[1:], term[0]) / math.log(len(alphabet))).otherwise(0.0)


def codon_table(table: int = 1) -> dict[str, str]:
    codes = {a + b + c: STANDARD[16 * i + 4 * j + k] for i, a in enumerate(BASES) for j, b in enumerate(BASES) for k, c in enumerate(BASES)}
    return codes | TABLE_CHANGES[table]


def codon(seq, i) -> Column:
    return F.substring(_c(seq), (_c(i) * 3 + 1).cast("int"), F.lit(3))


def translate(seq, table: int = 1) -> Column:
    """Protein of a coding sequence; codons with N are X, letters behind the last whole codon are left."""
    s, codes = _c(seq), F.create_map(*[F.lit(x) for kv in codon_table(table).items() for x in kv])
    codons = F.regexp_extract_all(s, F.lit("(?s).{3}"), F.lit(0))
    return F.array_join(F.transform(codons, lambda c: F.coalesce(F.try_element_at(codes, c), F.lit(UNKNOWN_AMINO))), "")


def first_stop(protein) -> Column:
    """Index of the first stop residue, the length if there is none."""
    p = _c(protein)
    return F.when(F.instr(p, "*") > 0, F.instr(p, "*") - 1).otherwise(F.length(p)).cast("long")


def validity(seq, table: int = 1) -> Column:
    """NOT_MOD3, NO_START, NONSENSE, NO_STOP or VALID: the first that holds."""
    s, p = _c(seq), translate(seq, table)
    n = F.length(p)
    return (
        F.when((F.length(s) % 3 != 0) | (F.length(s) == 0), "NOT_MOD3")
        .when(F.substring(p, 1, 1) != "M", "NO_START")
        .when(first_stop(p) < n - 1, "NONSENSE")
        .when(F.substring(p, -1, 1) != "*", "NO_STOP")
        .otherwise("VALID")
    )


def _row(prev: np.ndarray, ch: str, letters: np.ndarray, first: int) -> np.ndarray:
    step = np.minimum(prev[:-1] + (letters != ord(ch)), prev[1:] + 1)
    full = np.concatenate([[first], step])
    at = np.arange(len(full))
    return np.minimum.accumulate(full - at) + at


def infix_distance(a: str, b: str) -> int:
    """Least edit distance between the shorter text and any part of the longer one."""
    short, long = sorted((a, b), key=len)
    letters = np.array([ord(c) for c in long], np.int64)
    row = np.zeros(len(long) + 1, np.int64)
    for i, ch in enumerate(short, 1):
        row = _row(row, ch, letters, i)
    return int(row.min())


@F.pandas_udf(T.LongType())
def local_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else infix_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int64")


def lz76(text: str) -> int:
    """Number of components of the exhaustive history of a text (Lempel and Ziv, 1976), in linear time.

    A component is the shortest text that doesn't occur in what stands before its last letter. A suffix automaton of all
    letters read so far follows the component letter by letter.
    """
    below, link, longest = [{}], [-1], [0]
    last = state = size = count = 0
    for ch in text:
        at = below[state].get(ch)  # is the component, with this letter, a part of what stands before the letter?
        new = len(below)
        below.append({})
        link.append(0)
        longest.append(longest[last] + 1)
        p = last
        while p >= 0 and ch not in below[p]:
            below[p][ch] = new
            p = link[p]
        if p >= 0:
            q = below[p][ch]
            if longest[p] + 1 == longest[q]:
                link[new] = q
            else:
                twin = len(below)
                below.append(dict(below[q]))
                link.append(link[q])
                longest.append(longest[p] + 1)
                while p >= 0 and below[p].get(ch) == q:
                    below[p][ch] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
        if at is None:
            count, state, size = count + 1, 0, 0
        else:
            state, size = at, size + 1
            while longest[link[state]] >= size:
                state = link[state]
    return count + (size > 0)


@F.pandas_udf(T.LongType())
def lempel_ziv(a: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else lz76(x) for x in a], dtype="Int64")


def author_key(surname, initials) -> Column:
    """Surname with commas made underscores, and the first initial in upper case."""
    return F.concat(F.replace(_c(surname), F.lit(","), F.lit("_")), F.lit("_"), F.upper(F.substring(_c(initials), 1, 1)))


def blosum_distance(a, b) -> Column:
    """Placeholder distance: always 0."""
    return F.lit(0.0)


AMINO = re.compile(r"^[ACDEFGHIKLMNPQRSTVWYUOX*\-]*$")


def is_amino(seq) -> Column:
    return F.upper(_c(seq)).rlike(AMINO.pattern)
