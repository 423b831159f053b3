"""Enrichment, membership and comparison joins.

No join carries a broadcast hint unless the frame is bounded by construction: AQE turns a join into a broadcast
from measured sizes and splits skewed partitions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow import constants as K
from winnow.functions import scalars as S
from winnow.functions.sequences import assemble_parts
from winnow.operators.gates import size_gate
from winnow.operators.numbering import rank_in_group


def enrich_metadata(
    df: DataFrame,
    metadata: DataFrame,
    key: str = "uniprot_acc",
    length_col: str = "protein_length_aa",
    organism_col: str = "organism",
    genus_col: str = "genus",
) -> DataFrame:
    """Fill missing length, organism and genus from the metadata table; existing values win.

    Only rows that lack something are joined, so complete rows are never shuffled.
    """
    types = {length_col: "int", organism_col: "string", genus_col: "string"}
    absent = {c: F.lit(None).cast(t) for c, t in types.items() if c not in df.columns}
    base = df.withColumns(absent) if absent else df
    needs = F.col(length_col).isNull() | F.col(organism_col).isNull()
    usable = needs & F.col(key).isNotNull()

    extra = metadata.select(
        F.col(key), F.col(length_col).cast("int").alias("_length"), F.col(organism_col).alias("_organism")
    )
    filled = base.filter(usable).join(extra, key, "left").withColumns(
        {
            length_col: F.coalesce(F.col(length_col), F.col("_length")),
            organism_col: F.coalesce(F.col(organism_col), F.col("_organism")),
        }
    )
    out = filled.select(*base.columns).unionByName(base.filter(~usable))
    organism = F.coalesce(F.col(organism_col), F.lit(K.UNKNOWN_NAME))
    return out.withColumn(organism_col, organism).withColumn(
        genus_col, F.coalesce(F.col(genus_col), S.genus_of(organism_col))
    )


def calibrated_only(wider: DataFrame, narrower: DataFrame, key: str) -> DataFrame:
    """Rows of the wider selection missing from the narrower one."""
    return wider.join(narrower.select(key), key, "left_anti")


def membership_flag(df: DataFrame, members: DataFrame, key: str, flag: str) -> DataFrame:
    marked = members.select(key).distinct().withColumn(flag, F.lit(True))
    return df.join(marked, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def attach_results(df: DataFrame, results: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Columns of a result table by id; designs without a result get NULL."""
    return df.join(results.select(key, *columns), key, "left")


def skip_done(todo: DataFrame, done: Sequence[DataFrame], key: str) -> DataFrame:
    """Rows whose key is in none of the done-sets."""
    for finished in done:
        todo = todo.join(finished.select(key), key, "left_anti")
    return todo


def lookup_required(df: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Attributes of a dimension by key; an unknown key fails the job with its value."""
    marked = dimension.withColumn("_known", F.lit(True))
    joined = df.join(marked, key, "left")
    checked = F.when(F.col("_known"), F.col(key)).otherwise(
        F.raise_error(F.concat(F.lit(f"unknown {key}: "), F.col(key).cast("string"))).cast(df.schema[key].dataType)
    )
    return joined.withColumn(key, checked).drop("_known")


def compare_versions(
    old: DataFrame, new: DataFrame, key: str, columns: Sequence[str], suffixes: tuple[str, str] = ("_old", "_new")
) -> DataFrame:
    """Values of both versions and their difference, for keys in either."""
    left = old.select(key, *[F.col(c).alias(c + suffixes[0]) for c in columns])
    right = new.select(key, *[F.col(c).alias(c + suffixes[1]) for c in columns])
    return left.join(right, key, "full_outer").withColumns(
        {f"{c}_delta": F.col(c + suffixes[1]) - F.col(c + suffixes[0]) for c in columns}
    )


def merge_sources(sources: Sequence[tuple[str, DataFrame]], label: str = "source") -> DataFrame:
    """Union by name with a provenance label."""
    frames = [df.withColumn(label, F.lit(name)) for name, df in sources]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


# --- structures ------------------------------------------------------------------------------------------------


def _distance(a: Column, b: Column) -> Column:
    dx, dy, dz = a["x"] - b["x"], a["y"] - b["y"], a["z"] - b["z"]
    return S.round_exact(F.sqrt(dx * dx + dy * dy + dz * dz), 2)


def check_geometry(
    designs: DataFrame,
    atoms: DataFrame,
    references: DataFrame,
    key: str = "design_id",
    reference_col: str = "reference_id",
    default_reference: str = K.DEFAULT_PARENT,
    tolerance: float = K.GEOMETRY_TOLERANCE,
    min_confidence: float = K.GEOMETRY_CONFIDENCE,
) -> DataFrame:
    """Observed against reference pair distances.

    `references` has one row per reference: its residues (array<int>) and pairs (array<struct<r1,r2,dist>>). A
    design gathers only its reference residues, and distances are taken inside the row instead of by a self-join.
    """
    wanted = designs.withColumn(
        reference_col,
        F.coalesce(F.col(reference_col), F.lit(default_reference))
        if reference_col in designs.columns
        else F.lit(default_reference),
    )
    known = wanted.join(references, reference_col, "left")
    # atoms meet the residues of their own design's reference, both dealt by the design; what a task then gathers per
    # design is its reference's residues, however many other references name, and any atom says that it has a structure
    needed = known.select(key, reference_col, "residues").repartition(key).dropDuplicates([key, reference_col])
    narrow = atoms.select(key, "res_seq", "x", "y", "z", "b")
    wanted_here = F.coalesce(F.array_contains("residues", F.col("res_seq")), F.lit(False))
    site = F.when(wanted_here, F.struct("res_seq", F.struct("x", "y", "z", "b").alias("p")))
    found = (
        needed.join(narrow, key)
        .groupBy(key, reference_col)
        .agg(F.collect_list(site).alias("_sites"), F.lit(True).alias("_has_structure"))
    )
    joined = known.join(found, [key, reference_col], "left")

    at = F.coalesce(
        F.map_from_entries("_sites"), F.create_map().cast("map<int,struct<x:double,y:double,z:double,b:double>>")
    )
    joined = joined.withColumn("_at", at)
    missing = F.filter("residues", lambda r: ~F.map_contains_key("_at", r))
    deviations = F.transform(
        "pairs",
        lambda p: F.struct(
            p["r1"].alias("r1"),
            p["r2"].alias("r2"),
            F.abs(
                _distance(F.try_element_at("_at", p["r1"]), F.try_element_at("_at", p["r2"])) - p["dist"]
            ).alias("deviation"),
        ),
    )
    joined = joined.withColumns({"_missing": missing, "_dev": deviations})
    worst = F.coalesce(F.array_max(F.transform("_dev", lambda d: d["deviation"])), F.lit(0.0))
    single = F.size("residues") < 2
    lone = F.try_element_at("_at", F.get("residues", F.lit(0)))["b"] >= min_confidence
    usable = F.col("_has_structure") & F.col("residues").isNotNull()
    complete = usable & (F.size("_missing") == 0)
    valid = F.when(complete & single, F.coalesce(lone, F.lit(False))).when(complete, worst <= tolerance).when(
        F.col("_has_structure"), False
    )
    out = F.when(complete & single, 0.0).when(complete, S.round_exact(worst, 3)).when(
        F.col("_has_structure"), float("inf")
    )
    return joined.withColumns(
        {
            "active_site_valid": valid,
            "active_site_max_dev": out,
            "active_site_missing_residues": F.when(usable, F.col("_missing")).otherwise(
                F.array().cast("array<int>")
            ),
            "catalytic_residue_plddt": F.when(
                complete, F.transform_values("_at", lambda _, p: p["b"])
            ).otherwise(F.create_map().cast("map<int,double>")),
            "residue_deviations": F.when(
                complete,
                F.transform(
                    F.filter("_dev", lambda d: d["deviation"].isNotNull()),
                    lambda d: F.struct(d["r1"], d["r2"], S.round_exact(d["deviation"], 3).alias("deviation")),
                ),
            ),
        }
    ).select(
        *wanted.columns, "active_site_valid", "active_site_max_dev", "active_site_missing_residues", "residue_deviations",
        "catalytic_residue_plddt",
    )


def derive_references(references: DataFrame, atoms: DataFrame, reference_col: str = "reference_id") -> DataFrame:
    """References whose pair distances are measured in their own structures.

    `atoms` holds the reference structures (reference_col, res_seq, x, y, z). A reference with a structure gets the
    distances of all pairs of its residues found there; one without keeps its stated distances.
    """
    sites = references.select(reference_col, F.explode("residues").alias("res_seq"))
    placed = sites.join(atoms, [reference_col, "res_seq"]).select(reference_col, F.struct("res_seq", "x", "y", "z").alias("p"))
    found = placed.groupBy(reference_col).agg(F.array_sort(F.collect_list("p")).alias("_p"))
    pairs = F.flatten(
        F.transform(
            "_p",
            lambda a, i: F.transform(
                F.slice("_p", i + 2, F.size("_p")),
                lambda b: F.struct(a["res_seq"].alias("r1"), b["res_seq"].alias("r2"), _distance(a, b).alias("dist")),
            ),
        )
    )
    measured = found.select(reference_col, pairs.alias("_pairs"))
    joined = references.join(measured, reference_col, "left")
    return joined.withColumn("pairs", F.coalesce("_pairs", "pairs")).select(*references.columns)


# --- chimera library -------------------------------------------------------------------------------------------


def block_product(left: DataFrame, right: DataFrame, blocks: int | None = None) -> DataFrame:
    """All combinations of two frames as an equi-join on the cells of a grid.

    Each side is dealt over one edge of the grid and copied along the other, so either may be the large one and every
    cell holds a bounded share of the output. A side with fewer rows than blocks is dealt row by row and gets an edge
    no longer than its rows, which leaves the other edge to the larger side.
    """
    blocks = blocks or left.sparkSession.sparkContext.defaultParallelism
    few = left.limit(blocks).count()
    rows = max(1, min(few, math.isqrt(blocks))) if few == blocks else max(1, few)
    columns = -(-blocks // rows)
    dealt = left.withColumn("_row", _dealt(left, rows, few < blocks))
    dealt = dealt.withColumn("_column", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    other = right.withColumn("_column", F.pmod(F.xxhash64(*right.columns), F.lit(columns)).cast("int"))
    other = other.withColumn("_row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    return dealt.join(other, ["_row", "_column"]).drop("_row", "_column")


def _dealt(df: DataFrame, parts: int, one_by_one: bool) -> Column:
    if one_by_one:
        # fewer rows than blocks, so the window is bounded
        return (F.row_number().over(Window.orderBy(F.xxhash64(*df.columns))) - 1).cast("int")
    return F.pmod(F.xxhash64(*df.columns), F.lit(parts)).cast("int")


def generate_chimeras(
    modules: DataFrame,
    cores: DataFrame,
    guides: DataFrame,
    linkers: DataFrame,
    bounds: tuple[int, int] = K.SIZE_RANGE,
    repeated: tuple[str, str] = K.REPEATED_PAIR,
) -> DataFrame:
    """All cores x guide modules x linkers within the size bounds.

    modules: name, source_scaffold, sequence; cores: core_rank, core, parts (array of module names);
    guides: guide_rank, guide, guide_module; linkers: linker_rank, linker, linker_sequence. The product is the
    result itself, so its size is the output size; module sequences arrive by equi-joins first. Equal rows of `modules`
    count once; names that stand for different modules must be told apart by the caller.
    """
    info = modules.select("name", "source_scaffold", F.col("sequence").alias("part_sequence")).distinct()
    core_rows = cores.select("core_rank", "core", F.posexplode("parts").alias("at", "name"))
    filled = (
        core_rows.join(info, "name", "left")
        .groupBy("core_rank", "core")
        .agg(
            F.array_sort(F.collect_list(F.struct("at", "name", "source_scaffold", "part_sequence"))).alias("_core"),
            F.bool_and(F.col("part_sequence").isNotNull()).alias("_complete"),
        )
        .filter("_complete")
    )
    guide_rows = guides.join(info, guides["guide_module"] == info["name"]).select(
        "guide_rank", "guide", "guide_module", "source_scaffold", "part_sequence"
    )
    product = block_product(linkers, block_product(filled, guide_rows))

    names = F.concat(F.transform("_core", lambda m: m["name"]), F.array("guide_module"))
    sources = F.concat(F.transform("_core", lambda m: m["source_scaffold"]), F.array("source_scaffold"))
    texts = F.concat(F.transform("_core", lambda m: m["part_sequence"]), F.array("part_sequence"))
    built = product.select(
        "core_rank", "guide_rank", "linker_rank", "core", "guide", "linker", "linker_sequence", "guide_module",
        names.alias("_names"), sources.alias("_sources"), texts.alias("_texts"),
    ).withColumn("full_sequence", assemble_parts("_texts", "linker_sequence"))
    sized = size_gate(built.withColumn("total_aa", F.length("full_sequence")), "total_aa", bounds)

    order = [F.asc("core_rank"), F.asc("guide_rank"), F.asc("linker_rank")]
    numbered = rank_in_group(sized, [], order, "_rank", ["core_rank", "guide_rank", "linker_rank"])
    used = F.transform(
        F.arrays_zip("_names", "_sources"),
        lambda m, i: F.struct(
            m["_names"].alias("module_name"),
            m["_sources"].alias("source_scaffold"),
            (i + 1).alias("position_in_chimera"),
        ),
    )
    junctions = F.transform(
        F.slice("_names", 2, F.size("_names")),
        lambda _, i: F.struct(
            (i + 1).alias("junction_index"),
            F.col("linker").alias("linker_name"),
            F.col("linker_sequence").alias("sequence"),
        ),
    )
    return numbered.select(
        F.format_string(K.CHIMERA_ID, "_rank", "core", "guide", "linker").alias("design_id"),
        F.lit(K.STRATEGY_SWAP).alias("strategy"),
        used.alias("modules_used"),
        junctions.alias("linkers"),
        "full_sequence",
        "total_aa",
        S.guide_template("guide_module").alias("guide_template"),
        F.lit(K.CLASS_FREE).alias("expected_mechanism"),
        F.struct(
            F.col("core").alias("catalytic_core"),
            F.col("guide").alias("rna_module"),
            "linker",
            F.col("_names").alias("modules"),
            ((F.col("core") == repeated[0]) & (F.col("guide_module") == repeated[1])).alias("sequence_repeat"),
        ).alias("provenance"),
    )


def slice_modules(sequences: DataFrame, modules: DataFrame, scaffold_col: str = "source_scaffold") -> DataFrame:
    """Module texts cut from their scaffold, 1-based and inclusive; the end is clamped to the length.

    sequences: id, sequence; modules: name, source_scaffold, start_residue, end_residue. Modules without a scaffold
    sequence are kept with NULL.
    """
    text = F.substr(
        F.col("sequence"), F.col("start_residue"), F.col("end_residue") - F.col("start_residue") + 1
    )
    source = sequences.select(F.col("id").alias(scaffold_col), "sequence")
    return modules.join(source, scaffold_col, "left").withColumn("sequence", text)
