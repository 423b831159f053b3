"""Sequence and array functions as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow import constants as K
from winnow.functions.scalars import ColumnLike, col


def letters(text: ColumnLike) -> Column:
    """Upper-case ASCII letters of a text, as a sequence."""
    return F.upper(F.regexp_replace(col(text), "[^A-Za-z]", ""))


def translate_codons(
    sequence: ColumnLike, table: Mapping[str, str] = K.CODONS, unknown: str = K.CODON_UNKNOWN
) -> Column:
    codons = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    parts = F.filter(F.split(F.upper(col(sequence)), ""), lambda c: c != "")
    return F.array_join(F.transform(parts, lambda c: F.coalesce(F.try_element_at(codons, c), F.lit(unknown))), "")


def gc_fraction(dna: ColumnLike) -> Column:
    """Share of G and C; empty or missing gives 0."""
    upper = F.upper(col(dna))
    rest = F.length(F.translate(upper, "GC", ""))
    return F.when(F.length(upper) > 0, (F.length(upper) - rest) / F.length(upper)).otherwise(0.0)


def motif_hits(dna: ColumnLike, motifs: Mapping[str, str] = K.RESTRICTION_SITES) -> Column:
    """Sorted names of the motifs contained in the text."""
    upper = F.upper(col(dna))
    named = [F.when(upper.contains(site), F.lit(name)) for name, site in sorted(motifs.items())]
    return F.array_compact(F.array(*named))


def starts_open(sequence: ColumnLike) -> Column:
    return F.coalesce(F.upper(F.substring(col(sequence), 1, 1)) == "M", F.lit(False))


def build_orf(sequence: ColumnLike, prefix: bool = True, suffix: bool = True, strict: bool = True) -> Column:
    """Coding sequence with optional leader and stop; a sequence not starting with M is an error or NULL."""
    orf = F.concat(
        F.lit(K.KOZAK if prefix else ""), translate_codons(sequence), F.lit(K.STOP_CODON if suffix else "")
    )
    bad = F.raise_error(F.lit("sequence is empty or does not start with M")) if strict else F.lit(None)
    return F.when(starts_open(sequence), orf).otherwise(bad.cast("string"))


def wrap_text(text: ColumnLike, width: int = 60) -> Column:
    return F.regexp_replace(col(text), "(.{%d})(?=.)" % width, "$1\n")


def kmer_windows(df: DataFrame, id_col: str, sequence_col: str, k: int, piece: int = 2048) -> DataFrame:
    """One row per window: id, 1-based start, window text.

    The text is cut into pieces of bounded length (never below the window), each with the first k - 1 characters of the
    next, and one pass of a pattern over a piece gives its windows: the work is linear in the text, and no row carries
    more than its piece or window.
    """
    piece = max(piece, k)
    cut = "(?s)(.{1,%d})(?=(.{0,%d}))" % (piece, k - 1)
    part, following = (F.regexp_extract_all(F.col(sequence_col), F.lit(cut), F.lit(g)) for g in (1, 2))
    texts = F.zip_with(part, following, lambda a, b: F.concat(a, b))
    pieces = df.select(id_col, F.posexplode(texts).alias("_nth", "_text"))
    # a character is consumed after each look ahead, so that a window never starts inside one
    windows = F.regexp_extract_all("_text", F.lit("(?s)(?=(.{%d}))." % k), F.lit(1))
    inside = pieces.select(id_col, "_nth", F.posexplode(windows).alias("_at", "window"))
    return inside.select(id_col, (F.col("_nth") * piece + F.col("_at") + 1).cast("int").alias("start"), "window")


def matches(a: ColumnLike, b: ColumnLike) -> Column:
    """Equal characters over the common prefix length."""
    a, b = col(a), col(b)
    n = F.least(F.length(a), F.length(b))
    left = F.split(F.substr(a, F.lit(1), n), "")
    right = F.split(F.substr(b, F.lit(1), n), "")
    same = F.aggregate(
        F.zip_with(left, right, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda acc, x: acc + x
    )
    return F.when(n > 0, same).when(n == 0, 0)


def positional_identity(a: ColumnLike, b: ColumnLike) -> Column:
    a, b = col(a), col(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a.isNotNull() & b.isNotNull() & (longest > 0), matches(a, b) / longest)


def novel_count(sequence: ColumnLike, wild_type: ColumnLike) -> Column:
    return F.length(col(wild_type)) - matches(sequence, wild_type)


def apply_mutations(sequence: ColumnLike, mutations: ColumnLike) -> Column:
    """Write every (position, mut_aa) into the sequence in list order; later entries win."""
    return F.aggregate(
        col(mutations), col(sequence), lambda s, m: F.overlay(s, m["mut_aa"], m["position"], F.lit(1))
    )


def mutation_fingerprint(mutations: ColumnLike) -> Column:
    """Order-free text key of a mutation set."""
    keys = F.transform(col(mutations), lambda m: F.format_string("%08d%s", m["position"], m["mut_aa"]))
    return F.array_join(F.array_sort(F.array_distinct(keys)), "|")


def mapped_positions(
    strategy: ColumnLike,
    length: ColumnLike,
    positions: Sequence[int] = K.CATALYTIC_POSITIONS,
    reference_length: int = K.CATALYTIC_LENGTH,
    exact: Sequence[str] = ("A", "C", "D"),
    proportional: Sequence[str] = ("B",),
) -> Column:
    """Positions to read: the list clipped to the length, or scaled to the length with a window of one."""
    s, n = col(strategy), col(length)
    listed = F.array(*[F.lit(p) for p in positions])
    clipped = F.filter(listed, lambda p: p <= n)
    # Python rounds halves to even, as bround does
    around = []
    for p in positions:
        centre = F.bround(F.lit(p / reference_length) * n, 0).cast("int")
        around += [centre - 1, centre, centre + 1]
    scaled = F.array_sort(
        F.array_distinct(F.transform(F.array(*around), lambda p: F.greatest(F.lit(1), F.least(n, p))))
    )
    return (
        F.when(s.isin(*exact), clipped)
        .when(s.isin(*proportional), scaled)
        .otherwise(F.array().cast("array<int>"))
    )


def cosine_distance(a: ColumnLike, b: ColumnLike, empty: str = "sum") -> Column:
    """1 - cosine; 1.0 when an operand is empty, judged by its element sum or (sane form) by its norm."""
    a, b = col(a), col(b)

    def total(array: Column, f) -> Column:
        return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + f(x.cast("double")))

    dot = F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x
    )
    norm_a = F.sqrt(total(a, lambda x: x * x))
    norm_b = F.sqrt(total(b, lambda x: x * x))
    if empty == "sum":
        blank = (total(a, lambda x: x) == 0) | (total(b, lambda x: x) == 0)
    else:
        blank = (norm_a == 0) | (norm_b == 0)
    return F.when(blank, 1.0).otherwise(1.0 - dot / F.nullif(norm_a * norm_b, F.lit(0.0)))


def assemble_parts(parts: ColumnLike, linker: ColumnLike) -> Column:
    """Parts joined with the linker at every junction."""
    joined = F.aggregate(
        F.slice(col(parts), F.lit(2), F.greatest(F.size(col(parts)) - 1, F.lit(0))),
        F.get(col(parts), F.lit(0)),
        lambda acc, p: F.concat(acc, col(linker), p),
    )
    return joined
