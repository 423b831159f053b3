"""FASTA text as a table. Records are split by the text source itself, so large files are read in parallel."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.functions.sequences import wrap_text


def parse_records(records: DataFrame, value_col: str = "value", starts_col: str | None = None) -> DataFrame:
    """id, header and sequence from texts split at line-initial '>'.

    `starts_col` marks the texts that stand at the start of a file. Only such a text can still have its own '>'; without
    one it is what precedes the file's first record, and is dropped. Other texts are records whatever they begin with.
    Without the column every text is a record, with or without its '>'.
    """
    text = F.regexp_replace(F.regexp_replace(F.col(value_col), "\r", ""), "^>", "")
    header = F.substring_index(text, "\n", 1)
    body = F.when(F.instr(text, "\n") > 0, F.substr(text, F.instr(text, "\n") + 1)).otherwise("")
    first = F.substring_index(F.regexp_replace(F.ltrim(header), r"\s.*$", ""), "\n", 1)
    kept = records.filter(F.length(F.trim(value_col)) > 0)
    if starts_col:
        kept = kept.filter(~F.col(starts_col) | F.startswith(F.col(value_col), F.lit(">")))
    return kept.select(first.alias("id"), F.trim(header).alias("header"), F.regexp_replace(body, r"\s", "").alias("sequence"))


def parse_header_tags(df: DataFrame, header_col: str = "header", tags: Sequence[str] | None = None) -> DataFrame:
    """Header tokens `[k=v]` and `k=v` as a map, or as columns when their names are given."""
    found = F.regexp_extract_all(F.col(header_col), F.lit(r"([A-Za-z_][A-Za-z0-9_]*)=([^\s\]]+)"), F.lit(0))
    entries = F.transform(
        found, lambda t: F.struct(F.substring_index(t, "=", 1).alias("k"), F.substr(t, F.instr(t, "=") + 1).alias("v"))
    )
    # a repeated key keeps its first value
    firsts = F.filter(
        F.transform(entries, lambda e, i: F.struct(e["k"], e["v"], i.alias("i"))),
        lambda e: F.array_position(F.transform(entries, lambda x: x["k"]), e["k"]) == e["i"] + 1,
    )
    out = df.withColumn("tags", F.map_from_entries(F.transform(firsts, lambda e: F.struct(e["k"], e["v"]))))
    if tags is None:
        return out
    return out.withColumns({t: F.try_element_at("tags", F.lit(t)) for t in tags}).drop("tags")


def _mark_file_starts(batches):
    """Add _starts: whether a text is the first one of its file. Batches come in the order of the scan."""
    last = None
    for batch in batches:
        paths = batch.column("_file")
        before = pa.concat_arrays([pa.array([last], paths.type), paths[:-1]])
        changed = pc.fill_null(pc.not_equal(paths, before), True)
        starts = pc.and_(changed, pc.equal(batch.column("_block"), 0))
        last = paths[-1].as_py() if len(paths) else last
        yield pa.RecordBatch.from_arrays([batch.column("value"), starts], ["value", "_starts"])


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Records of FASTA files. What precedes a file's first record is told from records by its place, not by its text."""
    texts = spark.read.option("lineSep", "\n>").text(path)
    placed = texts.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    return parse_records(placed.mapInArrow(_mark_file_starts, "value string, _starts boolean"), starts_col="_starts")


def format_records(df: DataFrame, id_col: str, sequence_col: str, tags: Sequence[tuple[str, str, str]] = (), width: int = 60) -> DataFrame:
    """FASTA text of each row; tags are (label, column, printf format). Rows without a sequence are skipped."""
    parts = [F.concat(F.lit(">"), F.col(id_col).cast("string"))]
    for label, column, fmt in tags:
        parts.append(F.concat(F.lit(f"[{label}="), F.format_string(fmt, F.col(column)), F.lit("]")))
    body = wrap_text(sequence_col, width) if width else F.col(sequence_col)
    return df.filter(F.length(sequence_col) > 0).select(
        F.concat(F.concat_ws(" ", *parts), F.lit("\n"), body).alias("value")
    )


def write_fasta(df: DataFrame, path: str, id_col: str, sequence_col: str, tags: Sequence[tuple[str, str, str]] = (), width: int = 60) -> None:
    format_records(df, id_col, sequence_col, tags, width).write.text(path)
