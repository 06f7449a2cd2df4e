"""Column functions for reads, signals, sequences and intervals. Arguments are columns or their names."""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Roman numerals of the 16 chromosomes, fixed values.
ROMAN = ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII", "XIII", "XIV", "XV", "XVI"]


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


# intervals


def resize_center(s, e, width: int) -> tuple[Column, Column]:
    """The interval of width around the middle, which is rounded down."""
    start = F.floor((col(s) + col(e)) / 2) - width // 2
    return start, start + width - 1


def resize_start(s, e, strand, width: int) -> tuple[Column, Column]:
    """width bases from the start: s on strand +, e on strand -."""
    minus = col(strand) == "-"
    return F.when(minus, col(e) - (width - 1)).otherwise(col(s)), F.when(minus, col(e)).otherwise(col(s) + (width - 1))


def expand(s, e, n: int) -> tuple[Column, Column]:
    return col(s) - n, col(e) + n


def size_class(n) -> Column:
    """Size classes closed on the right: up to 1, 4, 12 and beyond."""
    n = col(n)
    return F.when(n <= 1, "spo").when(n <= 4, "2-4").when(n <= 12, "5-12").when(n > 12, "13+")


def two_classes(n) -> Column:
    return F.when(col(n) <= 1, "spo").when(col(n) > 1, "clustered")


# names and places


def genome_pos(strand, start, end, idx) -> Column:
    return F.when(col(strand) == "-", col(end) - col(idx)).otherwise(col(start) + col(idx))


def roman_chrom(c) -> Column:
    """chr4 as chrIV, for 1 to 16; other names stay."""
    names = F.create_map(*chain(*[(F.lit(f"chr{i + 1}"), F.lit(f"chr{r}")) for i, r in enumerate(ROMAN)]))
    return F.coalesce(F.try_element_at(names, col(c)), col(c))


def direction_strand(d) -> Column:
    return F.when(col(d) == "L", "+").when(col(d) == "R", "-")


def replicate_label(file) -> Column:
    return F.regexp_replace(F.substring_index(col(file), "_", 1), "[0-9]", "")


def standard_name(r) -> Column:
    """A read's name without a leading slash and what comes before read_."""
    r = col(r)
    name = F.when(F.contains(r, F.lit("read_")), F.element_at(F.split(r, "read_"), -1)).otherwise(r)
    return F.regexp_replace(name, "^/", "")


def parse_header(line) -> dict[str, Column]:
    """Columns of a call's header: its text after the last slash, up to a space, and the attributes of its dict."""
    line = col(line)

    def value(key: str) -> Column:
        return F.regexp_extract(line, rf"'{key}': *'?([^',}}]+)'?", 1)

    return {
        "read": F.regexp_extract(F.substring_index(line, " {", 1), r"([^/ ]*)$", 1),
        "chrom": value("mapped_chrom"), "strand": value("mapped_strand"),
        "start": value("mapped_start").try_cast("double").cast("long"), "end": value("mapped_end").try_cast("double").cast("long"),
    }


def status_fill(name, status) -> Column:
    return F.coalesce(F.nullif(col(name), F.lit("")), col(status))


# sequences


def revcomp(seq) -> Column:
    """Reverse complement; N is left out."""
    return F.reverse(F.translate(col(seq), "ACGTN", "TGCA"))


def collapse_mods(seq) -> Column:
    """Modified bases U, B, L, E and I as T."""
    return F.translate(col(seq), "UBLEI", "TTTTT")


def kmer_index(kmer) -> Column:
    """Number of a k-mer to the base 4, with A 0, T 1, C 2, G 3 and the most significant base first."""
    return F.conv(F.translate(col(kmer), "ATCG", "0123"), 4, 10).cast("long")


def has_noncanonical(seq) -> Column:
    return col(seq).rlike("[^ACGTacgt]")


def motif_mask(kmer, kind: str, base: str, k: int) -> Column:
    """Whether a k-mer has base in its middle (middle), in one of its two middles (either), or between its ends (inside)."""
    kmer = col(kmer)
    if kind == "middle":
        return F.substring(kmer, k // 2 + 1, 1) == base
    if kind == "either":
        return F.contains(F.substring(kmer, k // 2, 2), F.lit(base))
    return F.contains(F.substring(kmer, 2, k - 2), F.lit(base))


def motif_positions(seq, motif: str) -> Column:
    """Starts, from 0, of the matches of a fixed motif that do not overlap earlier ones."""
    # an element for each match and each letter outside: a match moves those behind it by its length less one
    parts = F.regexp_extract_all(col(seq), F.lit(f"(?s)({re.escape(motif)})|."), 1)
    places = F.filter(F.transform(parts, lambda x, i: F.when(x != "", i)), lambda i: i.isNotNull())
    return F.transform(places, lambda i, n: i + n * (len(motif) - 1))


def indicator(call) -> Column:
    """0 for T, 1 for B, null for others."""
    return F.when(col(call) == "T", 0).when(col(call) == "B", 1)


def decode_alphabet(codes, alphabet: str) -> Column:
    return F.array_join(F.transform(col(codes), lambda c: F.substring(F.lit(alphabet), c + 1, F.lit(1))), "")


def mod_encode(base, substitution, alphabet_size: int = 5) -> Column:
    """T as the sample's letter; letters outside ACGT as T for alphabets of four."""
    base = col(base)
    swapped = F.when(base == "T", col(substitution)).otherwise(base)
    return F.when(~swapped.isin("A", "C", "G", "T"), "T").otherwise(swapped) if alphabet_size == 4 else swapped


# alignments


def _cigar(cigar, ops: str) -> Column:
    found = F.regexp_extract_all(col(cigar), F.lit(f"([0-9]+)[{ops}]"), F.lit(1))
    return F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def cigar_ref_len(cigar) -> Column:
    """Sum of lengths of S, M, D and H less those of I."""
    return _cigar(cigar, "SMDH") - _cigar(cigar, "I")


def cigar_stats(cigar) -> dict[str, Column]:
    return {"n_ins": _cigar(cigar, "I"), "n_del": _cigar(cigar, "D"), "n_trim": _cigar(cigar, "S")}


def md_mismatches(md) -> dict[str, Column]:
    """Mismatches in all and by base of the reference; deletions (^...) don't count."""
    parts = F.regexp_extract_all(col(md), F.lit(r"(\^[A-Za-z]+|[0-9]+|[A-Za-z])"), F.lit(1))
    letters = F.filter(parts, lambda x: x.rlike("^[A-Za-z]$"))
    return {"mismatches": F.size(letters)} | {f"mis_{b.lower()}": _count_letter(letters, b) for b in "ACGT"}


def _count_letter(letters: Column, base: str) -> Column:
    return F.size(F.filter(letters, lambda x: x == base))


def edit_tag(tag) -> Column:
    """The value of a tag such as NM:i:3."""
    return F.get(F.split(col(tag), ":"), F.lit(2))


def ref_slice(ref_seq, pos, length, flag) -> Column:
    """length letters of an upper-case reference from pos (1-based); the reverse complement for flags 16 and 2064."""
    part = F.substring(F.upper(col(ref_seq)), col(pos), col(length))
    return F.when(col(flag).isin(16, 2064), revcomp(part)).otherwise(part)


# signals


def dac_to_current(dac, offset, range_, digitisation, shift=None, scale=None) -> Column:
    current = (col(dac) + col(offset)) * col(range_) / col(digitisation)
    return current if shift is None else (current - col(shift)) / col(scale)


def clip_signal(x, lo: float = -5, hi: float = 5, to_bound: bool = False) -> Column:
    """Values outside lo..hi as 0, or as the bound."""
    x = col(x)
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi)) if to_bound else F.when((x < lo) | (x > hi), 0).otherwise(x)


def const_scale(mean, kind: str = "a") -> Column:
    """(mean - 100) / 15 (a), (mean - 100) / 50 (b), mean / 100 - 0.66 (c)."""
    mean = col(mean)
    return {"a": (mean - 100) / 15, "b": (mean - 100) / 50, "c": mean / 100 - 0.66}[kind]


def logistic_calibrate(x, slope: float = 30, middle: float = 0.16) -> Column:
    return 1 / (1 + F.exp(-slope * (col(x) - middle)))


def fill_base_nulls(value, base, canonical: str) -> Column:
    return F.when(col(value).isNull() & (col(base) == canonical), 0).otherwise(col(value))


def encode_channels(mean, base, scale: float = 1.0, collapse: bool = False) -> Column:
    """array(mean / scale, A, T, C, G) with ones for the base; collapse takes B and I as T."""
    base = F.translate(col(base), "BI", "TT") if collapse else col(base)
    return F.array(col(mean) / scale, *[(base == b).cast("double") for b in "ATCG"])


def sample_weight(error, limit: float = 0.045, low: float = 0.1) -> Column:
    return F.when(col(error) <= limit, 1.0).otherwise(low)


def mixture_target(y) -> Column:
    """(0.5, 0.5, 0, 0) for 0, else (0.2, 0.8, 0, min(y / 0.8, 1))."""
    y = col(y)
    none = F.array(*[F.lit(v) for v in (0.5, 0.5, 0.0, 0.0)])
    some = F.array(F.lit(0.2), F.lit(0.8), F.lit(0.0), F.least(y / 0.8, F.lit(1.0)))
    return F.when(y == 0, none).otherwise(some)


# calls


def call_argmax(probs, letters: str = "ACGTB", threshold: float = 0.5) -> Column:
    """The letter of the largest probability, the first of equal ones; T and B are told apart by pB / (pT + pB) >= threshold."""
    probs = col(probs)
    at = F.array_position(probs, F.array_max(probs)).cast("int")
    best = F.substring(F.lit(letters), at, F.lit(1))
    t, b = F.get(probs, F.lit(letters.index("T"))), F.get(probs, F.lit(letters.index("B")))
    return F.when(best.isin("T", "B"), F.when(F.try_divide(b, t + b) >= threshold, "B").otherwise("T")).otherwise(best)


def call_multi_mod(base, canonical: str, mods: dict[str, Column | str], threshold: float = 0.5) -> Column:
    """The likeliest modification of a canonical base, if its probability is threshold or more; else the base. Ties go to the first."""
    p = {m: col(c) for m, c in mods.items()}
    top = F.greatest(*p.values()) if len(p) > 1 else next(iter(p.values()))
    winner = F.coalesce(*[F.when(c == top, m) for m, c in p.items()])
    return F.when((col(base) == canonical) & (top >= threshold), winner).otherwise(col(base))


def first_available(df: DataFrame, names: list[str]) -> str:
    """The first of some columns that df has."""
    for n in names:
        if n in df.columns:
            return n
    raise ValueError(f"none of {names} is among {df.columns}")


def set_constants(df: DataFrame, values: dict[str, str], replace: bool = False) -> DataFrame:
    """df with constant columns; numbers in strings become doubles, and columns that exist stay unless replace."""

    def typed(v):
        try:
            return F.lit(float(v))
        except ValueError:
            return F.lit(v)

    return df.withColumns({k: typed(v) for k, v in values.items() if replace or k not in df.columns})
