"""Distance to the nearest member of a known set, and mean pairwise identity without pairs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow import constants as K
from winnow.functions import scalars as S

PIVOTS = 256
BLOCK_ROWS = 16_384
BATCH_VECTORS = 2_048
# angles near zero lose half the digits of a cosine; bounds are trusted up to this
SLACK = 1e-6
DIRECT_SHARDS = 1_024
PLACES = 64
# a candidate may need every shard: no more than these, while the vectors of one fit these bytes
SHARDS = 32
SHARD_BYTES = 64 << 20
# copies of candidates that a task makes at once, and products that it holds
COPIES = 8_192
PRODUCTS = 4_000_000


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of a list column as rows; null components become NaN."""
    if not len(column):
        return np.zeros((0, 0))
    width = len(column[0])
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), width)


def _unit_rows(matrix: np.ndarray, empty: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows scaled to length one, the mask of rows counted as empty, and of those with a component that is no number."""
    norms = np.linalg.norm(matrix, axis=1)
    odd = ~np.isfinite(norms)
    blank = (matrix.sum(axis=1) == 0 if empty == "sum" else norms == 0) & ~odd
    return matrix / np.where((norms == 0) | odd, 1.0, norms)[:, None], blank, odd


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


@dataclass
class Cells:
    """Known vectors by their nearest pivot: count, and the least and largest angle to the pivot, of every cell.

    Cells are laid along the first axis of the pivots and packed into shards of at most `rows` vectors; a larger cell is
    dealt over several shards by a hash. Where that makes more than `SHARDS`, shards are larger, up to `SHARD_BYTES`.
    """

    pivots: np.ndarray
    counts: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray  # shard where a cell begins
    parts: np.ndarray  # shards that a cell is dealt over
    n_shards: int
    rows: int

    @classmethod
    def pack(cls, pivots: np.ndarray, counts: np.ndarray, low: np.ndarray, high: np.ndarray, rows: int) -> Cells:
        rows = max(rows, min(SHARD_BYTES // (8 * pivots.shape[1]), -(-int(counts.sum()) // SHARDS)))
        first, parts = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
        middle = pivots - pivots.mean(axis=0)
        along = middle @ np.linalg.svd(middle, full_matrices=False)[2][0]
        shard, filled = 0, 0
        for cell in np.argsort(along, kind="stable"):
            n = int(counts[cell])
            if filled and filled + n > rows:
                shard, filled = shard + 1, 0
            first[cell], parts[cell] = shard, max(1, -(-n // rows))
            if parts[cell] > 1:
                shard, filled = shard + int(parts[cell]), 0
            else:
                filled += n
        return cls(pivots, counts, low, high, first, parts, shard + (filled > 0), rows)

    def bounds(self, angles: np.ndarray, near: np.ndarray, cells: np.ndarray | slice = slice(None)) -> np.ndarray:
        """No member of a cell can be nearer than this: by the cell's ring around its pivot, and by the plane between."""
        ring = np.maximum(angles - self.high[cells], self.low[cells] - angles)
        return np.maximum(ring, (angles - near[:, None]) / 2)

    def route(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Angle to the nearest pivot, an upper bound on the nearest angle, and the shards that may hold the nearest."""
        angles = _angles(rows, self.pivots)
        near = angles.min(axis=1)
        upper = np.where(self.counts > 0, angles + self.low, np.inf).min(axis=1)
        may = (self.counts > 0) & (self.bounds(angles, near) <= upper[:, None] + SLACK)
        spread = [np.arange(f, f + n) for f, n in zip(self.first, self.parts)]
        return near, upper, [np.unique(np.concatenate([spread[c] for c in np.flatnonzero(row)])) for row in may]


class Shard:
    """The known vectors of one shard, cell by cell."""

    def __init__(self, cells: Cells, members: np.ndarray, rows: np.ndarray):
        order = np.argsort(members, kind="stable")
        self.cells, self.rows = cells, rows[order]
        self.ids, starts = np.unique(members[order], return_index=True)
        self.spans = list(zip(starts, [*starts[1:], len(order)]))

    def nearest(self, rows: np.ndarray, near: np.ndarray, upper: np.ndarray) -> np.ndarray:
        """Least distance of each row in this shard; infinite where the bounds rule all of it out."""
        best, limit = np.full(len(rows), np.inf), upper.copy()
        angles = _angles(rows, self.cells.pivots[self.ids])
        bounds = self.cells.bounds(angles, near, self.ids)
        for k in np.argsort(bounds.min(axis=0), kind="stable"):
            need = np.flatnonzero(bounds[:, k] <= limit + SLACK)
            if len(need):
                low, high = self.spans[k]
                step = max(1, PRODUCTS // (high - low))
                found = np.concatenate([1.0 - (rows[need[at : at + step]] @ self.rows[low:high].T).max(axis=1) for at in range(0, len(need), step)])
                best[need] = np.minimum(best[need], found)
                limit[need] = np.minimum(limit[need], np.arccos(np.clip(1.0 - found, -1.0, 1.0)))
        return best


def find_cells(vectors: DataFrame, vector_col: str, key: str, empty: str, pivots: int, rows: int) -> tuple[Cells | None, bool]:
    """Cells of the known vectors, and whether some count as empty; None without others.

    Two jobs: the first brings `pivots` vectors to the driver, those with the smallest hash of the key; the second one
    row per cell.
    """

    def usable(batches):
        for batch in batches:
            unit, blank, odd = _unit_rows(_matrix(batch.column(1)), empty)
            keep = np.flatnonzero(~blank & ~odd)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array([unit[k].tobytes() for k in keep], pa.binary())], ["h", "v"])

    hashed = vectors.select(F.xxhash64(key).alias("h"), vector_col)
    chosen = hashed.mapInArrow(usable, "h long, v binary").orderBy("h", "v").limit(pivots).collect()
    centres = np.unique(np.array([np.frombuffer(r["v"]) for r in chosen]), axis=0) if chosen else np.zeros((0, 0))

    def assign(batches):
        for batch in batches:
            unit, blank, odd = _unit_rows(_matrix(batch.column(0)), empty)
            if blank.any():
                yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([int(blank.sum())]), pa.array([0.0]), pa.array([0.0])], ["cell", "n", "low", "high"])
            unit = unit[~blank & ~odd]
            if len(unit):
                angles = _angles(unit, centres)
                at = angles.argmin(axis=1)
                own = angles[np.arange(len(at)), at]
                ids = np.unique(at)
                values = ([c for c in ids], [(at == c).sum() for c in ids], [own[at == c].min() for c in ids], [own[at == c].max() for c in ids])
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds)], ["cell", "n", "low", "high"])

    counted = vectors.select(vector_col).mapInArrow(assign, "cell long, n long, low double, high double").groupBy("cell")
    found = {r["cell"]: r for r in counted.agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect()}
    some_blank = found.pop(-1, None) is not None
    if not found:
        return None, some_blank
    columns = [np.array([found[c][name] if c in found else 0 for c in range(len(centres))], kind) for name, kind in (("n", np.int64), ("low", float), ("high", float))]
    return Cells.pack(centres, *columns, rows), some_blank


def nearest_known(
    candidates: DataFrame, known: DataFrame, key: str, vector_col: str, empty: str = "sum", pivots: int | None = None, rows: int | None = None
) -> DataFrame:
    """Unrounded distance (1 - cosine) of every candidate with a vector to its nearest known vector; exact.

    Known vectors go to the cell of their nearest pivot and are never copied but to balance a shard that many candidates
    need; a candidate goes once to each shard with a cell that the triangle inequality between angles does not rule out,
    and there meets only those cells. Shards are read in order, the known vectors first, then the candidates in batches,
    so a task holds one shard. Vectors that count as empty (by `empty`: zero sum, or zero length) have distance 1 to
    everything. Known vectors with a component that is no number are left out, and such candidates get no distance.
    Three jobs with a row per pivot, cell and shard run when this is called. Candidates that share a key share the least.
    """
    cells, some_blank = find_cells(known.filter(F.col(vector_col).isNotNull()).select(key, vector_col), vector_col, key, empty, pivots or PIVOTS, rows or BLOCK_ROWS)
    have = candidates.filter(F.col(vector_col).isNotNull()).select(key, vector_col)
    id_type = candidates.schema[key].dataType.simpleString()
    if cells is None:
        one = F.lit(1.0) if some_blank else F.lit(None).cast("double")
        return have.groupBy(key).agg(F.max(one).alias("distance"))
    block = cells.rows
    names = ["shard", "cell", "near", "upper", "vector", "distance"]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.float64()]
    schema = f"`{key}` {id_type}, shard long, cell long, near double, upper double, vector binary, distance double"

    def routed(batches):
        for batch in (b.slice(at, BATCH_VECTORS) for b in batches for at in range(0, b.num_rows, BATCH_VECTORS)):
            unit, blank, odd = _unit_rows(_matrix(batch.column(1)), empty)
            direct = np.flatnonzero(blank | (some_blank & ~odd))
            values = [-1 - np.arange(len(direct)) % DIRECT_SHARDS, [None] * len(direct), [None] * len(direct), [None] * len(direct), [None] * len(direct), np.ones(len(direct))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(direct)), *(pa.array(v, t) for v, t in zip(values, kinds))], [key, *names])
            usable = np.flatnonzero(~blank & ~odd)
            if len(usable):
                near, upper, shards = cells.route(unit[usable])
                packed = pa.array([unit[k].tobytes() for k in usable], pa.binary())
                to, sizes = np.concatenate(shards), np.array([len(s) for s in shards])
                ends = np.cumsum(sizes)
                for at in range(0, len(to), COPIES):
                    part = to[at : at + COPIES]
                    take = np.searchsorted(ends, np.arange(at, at + len(part)), side="right")
                    copied = [pa.array(part), pa.nulls(len(part), pa.int64()), pa.array(near[take]), pa.array(upper[take]), packed.take(pa.array(take))]
                    found = [batch.column(0).take(pa.array(usable[take])), *copied, pa.nulls(len(part), pa.float64())]
                    yield pa.RecordBatch.from_arrays(found, [key, *names])

    def placed(batches):
        for batch in batches:
            unit, blank, odd = _unit_rows(_matrix(batch.column(0)), empty)
            usable = ~blank & ~odd
            if usable.any():
                rows_, h = unit[usable], batch.column(1).to_numpy()[usable]
                at = _angles(rows_, cells.pivots).argmin(axis=1)
                values = [cells.first[at] + h % cells.parts[at], at, [r.tobytes() for r in rows_]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int64(), pa.int64(), pa.binary()))], ["shard", "cell", "vector"])

    asked = have.mapInArrow(routed, schema)
    # a shard that very many candidates need is copied, so that they are dealt over several tasks
    wide = asked.filter(F.col("shard") >= 0).groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 8 * block).collect()
    copies = F.create_map(*[F.lit(v) for r in wide for v in (r["shard"], -(-r["n"] // (8 * block)))]) if wide else None
    n_copies = F.coalesce(F.try_element_at(copies, F.col("shard")), F.lit(1)) if wide else F.lit(1)
    members = known.filter(F.col(vector_col).isNotNull()).select(vector_col, F.xxhash64(key).bitwiseAND(F.lit((1 << 62) - 1)))
    members = members.mapInArrow(placed, "shard long, cell long, vector binary").withColumn("copy", F.explode(F.sequence(F.lit(0), n_copies - 1)))
    asked = asked.withColumn("copy", F.pmod(F.xxhash64(key), n_copies).cast("int")).withColumn("side", F.lit(1))
    both = asked.unionByName(members.withColumn("copy", F.col("copy").cast("int")).withColumn("side", F.lit(0)), allowMissingColumns=True)
    dealt = both.select(key, *names, "copy", "side").repartition("shard", "copy").sortWithinPartitions("shard", "copy", "side")

    def compared(batches):
        current, shard, ids, parts = None, None, [], []
        for batch in batches:
            group = [(s, c) for s, c in zip(batch.column(1).to_pylist(), batch.column(7).to_pylist())]
            side = batch.column(8).to_numpy()
            cuts = [0, *(k for k in range(1, len(group)) if group[k] != group[k - 1] or side[k] != side[k - 1]), len(group)]
            for low, high in zip(cuts, cuts[1:]):
                if low == high:
                    continue
                if group[low] != current:
                    current, shard, ids, parts = group[low], None, [], []
                part = batch.slice(low, high - low)
                if group[low][0] < 0:
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(6)], [key, "distance"])
                    continue
                matrix = np.frombuffer(b"".join(part.column(5).to_pylist())).reshape(high - low, -1)
                if side[low] == 0:
                    ids.append(part.column(2).to_numpy())
                    parts.append(matrix)
                    continue
                if shard is None and parts:
                    shard = Shard(cells, np.concatenate(ids), np.concatenate(parts))
                if shard:
                    found = shard.nearest(matrix, part.column(3).to_numpy(), part.column(4).to_numpy())
                    hit = np.flatnonzero(np.isfinite(found))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(hit)), pa.array(found[hit])], [key, "distance"])

    found = dealt.mapInArrow(compared, f"`{key}` {id_type}, distance double")
    return found.groupBy(key).agg(F.min("distance").alias("distance"))


def novelty_gate(
    df: DataFrame,
    embeddings: DataFrame,
    known_ids: DataFrame,
    key: str = "uniprot_acc",
    vector_col: str = "embedding",
    threshold: float = K.GATE_NOVELTY,
    empty: str = "sum",
    pivots: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Keep candidates farther than the threshold from every known member; `pivots` and `rows` as in `nearest_known`.

    A candidate without a vector is kept with NULL status, and so is everything when no known id has a vector.
    """
    known = embeddings.join(known_ids.select(key).distinct(), key, "left_semi")
    wanted = embeddings.join(df.select(key).distinct(), key, "left_semi")
    distances = nearest_known(wanted, known, key, vector_col, empty, pivots, rows)
    joined = df.join(distances, key, "left")
    return (
        joined.withColumns(
            {
                "gate_6_distance": S.round_exact(F.col("distance"), 4),
                "gate_6_pass": F.col("distance") > threshold,
            }
        )
        .filter(F.coalesce("gate_6_pass", F.lit(True)))
        .drop("distance")
    )


def known_set(default_ids: DataFrame, extra_ids: DataFrame, key: str) -> DataFrame:
    """Default members plus the extra list, once each."""
    return default_ids.select(key).union(extra_ids.select(key)).distinct()


def _packed(text: str) -> tuple[bytes, int]:
    """The characters as one byte each, or four where one of them needs more, and that width."""
    try:
        return text.encode("latin-1"), 1
    except UnicodeEncodeError:
        return text.encode("utf-32-le", "surrogatepass"), 4


class Seen:
    """How often each character stood at each of `PLACES` places."""

    def __init__(self):
        self.known = np.zeros(0, dtype=np.int64)
        self.counts = np.zeros((PLACES, 0), dtype=np.int64)

    def add(self, parts: list[bytes], widths: np.ndarray) -> np.ndarray:
        """Take the parts in order; for each, the number of parts before it with its character, summed over its places."""
        rows, codes = [], []
        for width, kind in ((1, np.uint8), (4, np.uint32)):
            mine = np.flatnonzero(widths == width)
            rows.append(np.repeat(mine, [len(parts[i]) // width for i in mine]))
            codes.append(np.frombuffer(b"".join([parts[i] for i in mine]), dtype=kind).astype(np.int64))
        rows, codes = np.concatenate(rows).astype(np.int64), np.concatenate(codes)
        sizes = np.array([len(p) for p in parts]) // widths
        in_order = np.argsort(rows, kind="stable") if (widths != 1).any() else slice(None)
        rows, codes = rows[in_order], codes[in_order]
        places = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        fresh = np.setdiff1d(codes, self.known)
        if len(fresh):
            wider = np.union1d(self.known, fresh)
            counts = np.zeros((PLACES, len(wider)), dtype=np.int64)
            counts[:, np.searchsorted(wider, self.known)] = self.counts
            self.known, self.counts = wider, counts
        cell = places * len(self.known) + np.searchsorted(self.known, codes)
        order = np.argsort(cell, kind="stable")
        sorted_cells = cell[order]
        first = np.flatnonzero(np.concatenate(([True], sorted_cells[1:] != sorted_cells[:-1])))
        times = np.diff(np.append(first, len(cell)))
        before = np.empty(len(cell), dtype=np.int64)
        before[order] = np.arange(len(cell)) - np.repeat(first, times)
        flat = self.counts.reshape(-1)
        before += flat[cell]
        flat[sorted_cells[first]] += times
        return np.add.reduceat(before, np.cumsum(sizes) - sizes)


def mean_pairwise_identity(df: DataFrame, sequence_col: str) -> DataFrame:
    """Mean positional identity over all unordered pairs; NULL when there is no pair.

    A pair contributes its matches divided by the longer length. Texts are dealt in pieces by place and read by length:
    each meets the counts of the characters that shorter ones have at its places. The text is moved once, the cost is
    linear in it, no pair is formed, and a task holds the counts of `PLACES` places.
    """

    def pieces(batches):
        # texts in pieces of `PLACES` characters, one byte each where all characters of the text have one
        for batch in batches:
            for text in batch.column(0):
                given = text.as_py()
                data, width = _packed(given)
                step = PLACES * width
                parts = [data[at : at + step] for at in range(0, len(data), step)]
                for low in range(0, len(parts), BATCH_VECTORS):
                    some = parts[low : low + BATCH_VECTORS]
                    n = len(some)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.arange(low, low + n)), pa.array(np.full(n, len(given))), pa.array(np.full(n, width)), pa.array(some, pa.binary())],
                        ["block", "len", "width", "part"],
                    )

    def met(batches):
        # the pieces of a block by length: each meets the characters of the shorter ones at its places
        current, seen = None, Seen()
        for batch in batches:
            blocks, lengths, widths = (batch.column(i).to_numpy() for i in range(3))
            edges = np.flatnonzero(np.diff(blocks)) + 1
            for low, high in zip([0, *edges], [*edges, len(blocks)]):
                if low == high:
                    continue
                if blocks[low] != current:
                    current, seen = blocks[low], Seen()
                # a piece has up to `PLACES` characters, so a lot is bounded
                for at in range(low, high, BATCH_VECTORS):
                    end = min(high, at + BATCH_VECTORS)
                    found = seen.add(batch.column(3).slice(at, end - at).to_pylist(), widths[at:end])
                    kinds, row = np.unique(lengths[at:end], return_inverse=True)
                    sums = np.zeros(len(kinds), dtype=np.int64)
                    np.add.at(sums, row, found)
                    yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(sums)], ["len", "m"])

    texts = df.filter(F.length(sequence_col) > 0).select(F.col(sequence_col).alias("s"))
    cut = texts.mapInArrow(pieces, "block long, len long, width long, part binary")
    dealt = cut.repartition("block").sortWithinPartitions("block", "len")
    by_length = dealt.mapInArrow(met, "len long, m long").groupBy("len").agg(F.sum("m").alias("m"))
    total = by_length.agg(F.sum(F.col("m") / F.col("len")).alias("identity_sum"))
    count = df.filter(F.col(sequence_col).isNotNull()).agg(F.count(F.lit(1)).alias("n"))
    both = total.unionByName(count, allowMissingColumns=True).agg(
        F.max("identity_sum").alias("identity_sum"), F.max("n").alias("n")
    )
    n_pairs = F.col("n") * (F.col("n") - 1) / 2
    return both.select(
        n_pairs.cast("long").alias("n_pairs"),
        F.when(n_pairs > 0, F.coalesce("identity_sum", F.lit(0.0)) / n_pairs).alias("mean_identity"),
    )
