"""Scalar scoring rules as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from winnow import constants as K

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c: ColumnLike) -> Column:
    """The value as double with NaN turned into NULL (Spark ranks NaN above every number)."""
    return F.nanvl(col(c).cast("double"), F.lit(None).cast("double"))


def at_least(c: ColumnLike, threshold: float) -> Column:
    """Filter form of >=: reaches the scan, and NaN does not pass."""
    return (col(c) >= threshold) & ~F.isnan(col(c))


def above(c: ColumnLike, threshold: float) -> Column:
    """Filter form of >."""
    return (col(c) > threshold) & ~F.isnan(col(c))


def clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    # least/greatest skip NULL operands, so a missing value has to be kept apart
    return F.when(c.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), c)))


def _rounded(x: Column, digits: int) -> Column:
    scale = float(10**digits)
    product = x * scale
    high = x * 134217729.0 - (x * 134217729.0 - x)
    error = (high * scale - product) + (x - high) * scale
    below = F.floor(product)
    beyond = ((product - below) - 0.5) + error
    up = (beyond > 0) | ((beyond == 0) & (F.pmod(below, F.lit(2)) == 1))
    return F.when(F.abs(x) < 2.0**52 / scale, (below + F.when(up, 1).otherwise(0)) / scale).otherwise(x)


def round_exact(c: Column, digits: int) -> Column:
    """Round the binary value to `digits`, halves to even; infinities, NaN and values without such digits stay.

    Spark's round works on the shortest decimal text, which turns 0.99125 (stored slightly below) into 0.9913. The
    scaled value and the error of its product (split in two halves) tell on which side of the half the value lies. The
    operand is bound once, so nested scores stay small plans.
    """
    return F.transform(F.array(c.cast("double")), lambda x: _rounded(x, digits))[0]


def round_column(name: str, digits: int) -> Column:
    """`round_exact` of a plain double column of the frame: arithmetic only, so it stays in generated code."""
    return _rounded(F.col(name), digits)


# --- weighted scores -------------------------------------------------------------------------------------------


def weighted(profile: Mapping[str, float], axis: Mapping[str, Column] | None = None) -> Column:
    """Sum of axis x weight in profile order; a missing axis counts as 0."""
    total = None
    for name, weight in profile.items():
        value = axis[name] if axis and name in axis else F.col(name)
        term = F.coalesce(number(value), F.lit(0.0)) * F.lit(float(weight))
        total = term if total is None else total + term
    return total


def beats(score: ColumnLike, threshold: float = K.LOCKPOINT_VERBATIM) -> Column:
    """Strictly above the threshold."""
    return number(score) > F.lit(float(threshold))


def recalibrated(threshold: float, old: float, new: float, weight: float) -> float:
    """Threshold after one axis of the reference moved from `old` to `new`."""
    return threshold + (new - old) * weight


# --- single axes -----------------------------------------------------------------------------------------------


def score_class(label: ColumnLike) -> Column:
    label = col(label)
    return F.when(label == K.CLASS_FREE, 1.0).when(label == K.CLASS_NUCLEASE, 0.0).otherwise(0.5)


def score_cargo(label: ColumnLike, composite: ColumnLike) -> Column:
    free = col(label) == K.CLASS_FREE
    return F.when(free & F.coalesce(col(composite), F.lit(False)), 1.0).when(free, 0.85).otherwise(0.0)


def score_length(length: ColumnLike) -> Column:
    n = col(length).cast("double")
    short = 1.0 - (K.LENGTH_SHORT - n) / K.LENGTH_SHORT * K.LENGTH_LOSS_SHORT
    middle = 1.0 - (n - K.LENGTH_SHORT) / (K.LENGTH_MIDDLE - K.LENGTH_SHORT) * K.LENGTH_LOSS_MIDDLE
    long = K.LENGTH_LEFT_MIDDLE - (n - K.LENGTH_MIDDLE) / (K.LENGTH_LONG - K.LENGTH_MIDDLE) * K.LENGTH_LEFT_MIDDLE
    bounded = F.when(n <= K.LENGTH_SHORT, short).when(n <= K.LENGTH_MIDDLE, middle).when(n <= K.LENGTH_LONG, long)
    return bounded.when(n.isNotNull(), 0.0)


def score_load(n1: ColumnLike, n2: ColumnLike, scale: float = K.LOAD_SCALE) -> Column:
    return round_exact(clip(1.0 - (col(n1) + col(n2) * 0.5) / scale), 4)


def score_density(n: ColumnLike, length: ColumnLike, scale: float = K.DENSITY_SCALE) -> Column:
    return clip(1.0 - (col(n) / col(length)) / scale)


def score_immuno(precomputed: ColumnLike, strategy: ColumnLike, load: ColumnLike) -> Column:
    """Measured value first, the baseline for the targeted strategy, else a proxy from the window load."""
    base = K.BASELINE_IMMUNO
    proxy = clip((1.0 + (base - col(load).cast("double") / 50.0) * 0.1) * base)
    fallback = F.when(col(strategy) == K.STRATEGY_TARGETED, base).otherwise(F.coalesce(proxy, F.lit(base)))
    return F.coalesce(number(precomputed), fallback)


def score_maturity(strategy: ColumnLike, identity: ColumnLike) -> Column:
    """Inheritance by strategy prefix; `identity` to the parent is NULL when no parent is known."""
    s = col(strategy)
    identity = col(identity)
    inherited = F.when(identity.isNull() | (identity >= K.MATURITY_IDENTITY), K.BASELINE_MATURITY).otherwise(0.0)
    return F.when(s.startswith("D"), K.BASELINE_MATURITY * 0.5).when(s.startswith("C"), inherited).otherwise(0.0)


def raw_specificity(confidence: ColumnLike, probability: ColumnLike) -> Column:
    return F.least(F.lit(1.0), col(confidence) * 0.9 + col(probability) * 0.1)


def proxy_specificity(confidence: ColumnLike, probability: ColumnLike) -> Column:
    return round_exact(raw_specificity(confidence, probability), 4)


def raw_programmability(probability: ColumnLike, composite: ColumnLike) -> Column:
    flag = F.when(F.coalesce(col(composite), F.lit(False)), 1.0).otherwise(0.0)
    return F.least(F.lit(1.0), col(probability) * 0.8 + flag * 0.2)


def proxy_programmability(probability: ColumnLike, composite: ColumnLike) -> Column:
    return round_exact(raw_programmability(probability, composite), 4)


# --- labels and identifiers ------------------------------------------------------------------------------------


def flag_class(label: ColumnLike) -> Column:
    label = col(label)
    return (
        F.when(label == K.CLASS_UNKNOWN, K.FLAG_REVIEW)
        .when(label == K.CLASS_NUCLEASE, K.FLAG_DISCARD)
        .otherwise(K.FLAG_PASS)
    )


def strategy_from_id(identifier: ColumnLike, variant: str = "first") -> Column:
    """Strategy letter from naming rules; the second variant has no rule for bare D0 prefixes."""
    s = F.upper(col(identifier))
    if variant == "first":
        redesign = s.startswith(K.ID_REDESIGN) | s.contains(K.ID_REDESIGN_TOOL)
    else:
        redesign = s.contains(K.ID_REDESIGN_TOOL) | (s.startswith(K.ID_REDESIGN_LETTER) & s.contains(K.ID_REDESIGN_PARENT))
    return F.when(s.startswith(K.ID_SWAP), "A").when(redesign, "D").when(s.contains(K.ID_TARGETED), "C").otherwise("B")


def parent_of(
    identifier: ColumnLike,
    strategy: ColumnLike,
    parent: str = K.DEFAULT_PARENT,
    fixed: Sequence[str] = ("A", "C"),
    by_pattern: str = "D",
    pattern: str = K.REDESIGN_PATTERN,
) -> Column:
    s, i = col(strategy), col(identifier)
    return F.when(s.isin(*fixed) | ((s == by_pattern) & i.rlike(pattern)), parent).otherwise(i)


def genus_of(organism: ColumnLike) -> Column:
    """First word of the organism name; blank or missing names become Unknown."""
    word = F.split(F.trim(col(organism)), r"\s+")[0]
    return F.when(F.length(word) > 0, word).otherwise(K.UNKNOWN_NAME)


def mass_kda(sequence: ColumnLike) -> Column:
    return F.coalesce(F.length(col(sequence)), F.lit(0)) * 110 / 1000


# --- mutations and measurements --------------------------------------------------------------------------------


def residue_mass(residue: Column) -> Column:
    masses = F.create_map(*[F.lit(x) for pair in K.RESIDUE_MASS.items() for x in pair])
    return F.coalesce(F.try_element_at(masses, residue), F.lit(K.RESIDUE_MASS_OTHER))


def mutation_step(wt: ColumnLike, mut: ColumnLike) -> Column:
    """Unrounded substitution cost: base, polarity change, mass change."""
    wt, mut = col(wt), col(mut)
    crossed = F.lit(K.POLAR_RESIDUES).contains(wt) != F.lit(K.POLAR_RESIDUES).contains(mut)
    size = F.abs(residue_mass(wt) - residue_mass(mut)) / K.MUTATION_MASS_UNIT
    return (F.lit(K.MUTATION_BASE) + F.when(crossed, K.MUTATION_POLARITY).otherwise(0.0)) + size * K.MUTATION_MASS_WEIGHT


def mutation_cost(wt: ColumnLike, mut: ColumnLike, cap: float = K.MUTATION_CAP) -> Column:
    return round_exact(F.least(mutation_step(wt, mut), F.lit(cap)), 2)


def mutation_total(mutations: ColumnLike) -> Column:
    """Cost of a whole mutation list, rounded once at the end."""
    total = F.aggregate(
        col(mutations), F.lit(0.0), lambda acc, m: acc + mutation_step(m["wt_aa"], m["mut_aa"])
    )
    return round_exact(total, 2)


def stability_flags(ddg: ColumnLike) -> dict[str, Column]:
    d = number(ddg)
    return {
        "stability_warning": F.coalesce(d > K.DDG_WARN, F.lit(False)),
        "ddg_hard_gate_fail": F.coalesce(d > K.TRIAGE_DDG, F.lit(False)),
        "ddg_stabilizing": d < K.DDG_STABILISING,
    }


def choose_measurement(options: Sequence[tuple[str, ColumnLike]]) -> tuple[Column, Column]:
    """First available value and the name of its method, or 'none'."""
    values = [(name, number(c)) for name, c in options]
    method = F.lit("none")
    for name, value in reversed(values):
        method = F.when(value.isNotNull(), name).otherwise(method)
    return F.coalesce(*[v for _, v in values]), method


# --- small rule tables -----------------------------------------------------------------------------------------


def lookup_contains(value: ColumnLike, rules: Sequence[tuple[Sequence[str], str]], default: str | None) -> Column:
    """Attribute of the first rule with a keyword contained in the value."""
    value = col(value)
    out = F.lit(default)
    for words, attribute in reversed(list(rules)):
        hit = value.contains(words[0])
        for word in words[1:]:
            hit = hit | value.contains(word)
        out = F.when(hit, attribute).otherwise(out)
    return out


def guide_template(module: ColumnLike) -> Column:
    return lookup_contains(module, K.GUIDE_RULES, K.GUIDE_OTHER)


def linker_sequence(kind: ColumnLike, length: ColumnLike) -> Column:
    kind, length = col(kind), col(length)
    out = F.lit(None).cast("string")
    for name, (unit, step) in K.LINKER_UNITS.items():
        copies = F.greatest(F.lit(1), F.floor(length / step).cast("int"))
        out = F.when(kind == name, F.repeat(F.lit(unit), copies)).otherwise(out)
    return out


def linker_band(kind: ColumnLike) -> Column:
    kind = col(kind)
    out = F.lit("unknown")
    for name, band in K.LINKER_BAND.items():
        out = F.when(kind == name, band).otherwise(out)
    return out
