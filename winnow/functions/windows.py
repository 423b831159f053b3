"""Sliding-window scans over residue weights.

Catalyst has no prefix sum over an array, and lambda functions run interpreted per residue, so these scans hand
whole Arrow batches to numpy. Each row is independent: no shuffle, O(length) per row.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow import constants as K
from winnow.functions.scalars import ColumnLike, col

# places of a text for which window counts are held at once, some 300 bytes each
PART = 1 << 16
LOAD_TYPE = "n1 int, n2 int, positions1 array<int>, positions2 array<int>, weighted_load double"


def _weights(table: Mapping[str, int], other: int) -> np.ndarray:
    lut = np.full(256, other, dtype=np.int64)
    for residue, weight in table.items():
        lut[ord(residue)] = weight
    return lut


def _codes(sequence: str) -> np.ndarray:
    # one byte per character, so positions survive; characters outside Latin-1 become '?'
    return np.frombuffer(sequence.encode("latin-1", "replace"), dtype=np.uint8)


def _window_sums(weights: np.ndarray, k: int) -> np.ndarray:
    if len(weights) < k:
        return np.zeros(0, dtype=np.int64)
    total = np.concatenate(([0], np.cumsum(weights)))
    return total[k:] - total[:-k]


_NONE = np.zeros(0, dtype=np.int32)


def _lists(rows: list[np.ndarray], missing: np.ndarray) -> pa.Array:
    """A list column of whole numbers, built from one array: no object is made for a row or a number."""
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    values = np.concatenate([_NONE, *rows], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=pa.array(missing))


def window_load(
    sequence: ColumnLike,
    rule1: tuple[int, int] = K.WINDOW_CLASS_1,
    rule2: tuple[int, int] = K.WINDOW_CLASS_2,
    weights: Mapping[str, int] = K.WINDOW_WEIGHTS,
    other: int = K.WINDOW_WEIGHT_OTHER,
    positions: bool = True,
) -> Column:
    """Struct of window counts, start positions and n1 + n2/2.

    A window counts when its mean weight exceeds the threshold. Weights and thresholds are whole hundredths, so
    sums are compared exactly. Position arrays are left NULL on request: counts alone are far smaller.
    """
    lut = _weights(weights, other)

    @F.arrow_udf(LOAD_TYPE)
    def scan(batch: pa.Array) -> pa.Array:
        counts, starts = np.zeros((2, len(batch)), dtype=np.int32), ([], [])
        for row, text in enumerate(batch):
            w = None if (given := text.as_py()) is None else lut[_codes(given)]
            for c, (k, threshold) in enumerate((rule1, rule2)):
                found = np.flatnonzero(_window_sums(w, k) > threshold * k) if w is not None else _NONE
                counts[c, row] = len(found)
                if positions:
                    starts[c].append((found + 1).astype(np.int32))
        missing = batch.is_null().to_numpy(zero_copy_only=False)
        lists = [_lists(s, missing) if positions else pa.nulls(len(batch), pa.list_(pa.int32())) for s in starts]
        load = pa.array(counts[0] + 0.5 * counts[1], mask=missing)
        fields = [pa.array(counts[0], mask=missing), pa.array(counts[1], mask=missing), *lists, load]
        return pa.StructArray.from_arrays(fields, ["n1", "n2", "positions1", "positions2", "weighted_load"])

    return scan(col(sequence))


def _surface_mask(codes: np.ndarray, lut: np.ndarray, frozen: np.ndarray) -> np.ndarray:
    """Surface residues and their neighbours, frozen positions left out."""
    held = frozen[frozen <= len(codes)] - 1
    core = lut[codes]
    core[held] = False
    wide = core.copy()
    wide[1:] |= core[:-1]
    wide[:-1] |= core[1:]
    wide[held] = False
    return wide


def _surface_lut(residues: str) -> np.ndarray:
    lut = np.zeros(256, dtype=bool)
    lut[[ord(r) for r in residues]] = True
    return lut


def mutable_positions(
    sequence: ColumnLike,
    frozen: Iterable[int] = K.FROZEN_POSITIONS,
    residues: str = K.SURFACE_RESIDUES,
) -> Column:
    """Sorted 1-based positions open to substitution."""
    held = np.array(sorted(set(frozen)), dtype=np.int64)
    lut = _surface_lut(residues)

    @F.arrow_udf("array<int>")
    def scan(batch: pa.Array) -> pa.Array:
        spots = []
        for text in batch:
            given = text.as_py()
            spots.append(_NONE if given is None else (np.flatnonzero(_surface_mask(_codes(given), lut, held)) + 1).astype(np.int32))
        return _lists(spots, batch.is_null().to_numpy(zero_copy_only=False))

    return scan(col(sequence))


def _cost_table(alphabet: str, cap: float) -> np.ndarray:
    """Substitution cost by (current byte, alphabet index), in the operand order of the scalar rule."""
    def mass(r: str) -> int:
        return K.RESIDUE_MASS.get(r, K.RESIDUE_MASS_OTHER)

    table = np.empty((256, len(alphabet)))
    for code in range(256):
        current = chr(code)
        for j, new in enumerate(alphabet):
            crossed = (current in K.POLAR_RESIDUES) != (new in K.POLAR_RESIDUES)
            step = 0.3 + (0.8 if crossed else 0.0) + abs(mass(current) - mass(new)) / 30.0 * 0.5
            table[code, j] = round(min(step, cap), 2)
    return table


def _sliding(hits: np.ndarray, k: int) -> np.ndarray:
    """Sums of `k` neighbours along each row, by sums of 1, 2, 4, ... neighbours."""
    n, at, size, total = hits.shape[1] - k + 1, 0, 1, None
    while True:
        if k & size:
            part = hits[:, at : at + n]
            total, at = part if total is None else total + part, at + size
        if 2 * size > k:
            return total
        hits, size = hits[:, :-size] + hits[:, size:], 2 * size


def _covering(weights: np.ndarray, k: int, limit: int, deltas: np.ndarray) -> np.ndarray:
    """Change in the number of windows above the limit, by (delta of the weight at a place, place)."""
    n = len(weights)
    if n < k:
        return np.zeros((len(deltas), n), dtype=np.int8)
    padded = np.full(n + k - 1, -(2**30), dtype=np.int32)
    padded[k - 1 : n] = _window_sums(weights, k)
    # one byte a count: a window is at most 127 long
    hits = (padded[None, :] > np.concatenate(([limit], limit - deltas)).astype(np.int32)[:, None]).view(np.int8)
    counts = _sliding(hits, k)
    return counts[1:] - counts[0]


class _Scan:
    """Allowed single substitutions of a text.

    The windows of a place change by the difference between two weights alone, and weights are few: counts are taken
    once for each difference and looked up for each letter.
    """

    def __init__(self, frozen: Iterable[int], residues: str, alphabet: str, cap: float, single_max: float, block: int):
        self.held = np.array(sorted(set(frozen)), dtype=np.int64)
        self.surface, self.lut = _surface_lut(residues), _weights(K.WINDOW_WEIGHTS, K.WINDOW_WEIGHT_OTHER)
        self.letters = np.array(list(alphabet))
        codes = np.array([ord(a) for a in alphabet], dtype=np.uint8)
        self.costs, self.block = _cost_table(alphabet, cap), block
        self.allowed = (np.arange(256)[:, None] != codes[None, :]) & (self.costs <= single_max)
        # the classes of the new letters, and the difference that a letter of the text and a class make
        weights, self.kind = np.unique(self.lut[codes], return_inverse=True)
        self.deltas, step = np.unique(weights[None, :] - self.lut[:, None], return_inverse=True)
        self.step = step.reshape(256, len(weights))
        self.members = np.arange(len(weights))[:, None] == self.kind[None, :]
        self.n_allowed = (self.allowed[:, None, :] & self.members[None]).sum(axis=2)

    def parts(self, text: str):
        """The text part by part: codes, open places, first place of the part, changes of both classes by (difference, place)."""
        codes = _codes(text)
        spots = np.flatnonzero(_surface_mask(codes, self.surface, self.held))
        rules = (K.WINDOW_CLASS_1, K.WINDOW_CLASS_2)
        reach = max(k for k, _ in rules) - 1
        for low in range(0, len(codes), PART):
            first = max(0, low - reach)
            w = self.lut[codes[first : low + PART + reach]]
            mine = spots[np.searchsorted(spots, low) : np.searchsorted(spots, low + PART)]
            yield codes, mine, first, *(_covering(w, k, t * k, self.deltas) for k, t in rules)

    def found(self, codes: np.ndarray, places: np.ndarray, letters: np.ndarray, first: int, change1: np.ndarray, change2: np.ndarray):
        here = codes[places]
        step = self.step[here, self.kind[letters]]
        return places, letters, self.costs[here, letters], change1[step, places - first], change2[step, places - first]

    def blocks(self, text: str):
        """(places, letters, costs, change in windows of either class) of the substitutions of each block of places."""
        for codes, spots, first, change1, change2 in self.parts(text):
            for at in range(0, len(spots), self.block):
                part = spots[at : at + self.block]
                rows, cols = np.nonzero(self.allowed[codes[part]])
                yield self.found(codes, part[rows], cols, first, change1, change2)

    def best(self, text: str, n: int):
        """Numbers of allowed and of load-lowering substitutions, and the `n` best: (load, cost, place, letter, changes) by column."""
        allowed = lowering = 0
        kept = np.zeros((6, 0))
        for codes, spots, first, change1, change2 in self.parts(text):
            here = codes[spots]
            twice = 2 * change1 + change2  # the load change in halves
            load = twice.ravel()[self.step[here].T * twice.shape[1] + (spots - first)]
            ways = self.n_allowed[here].T
            upto = np.cumsum(np.bincount(load.ravel().astype(np.int64) + 128, ways.ravel(), 256)).astype(np.int64)
            allowed, lowering = allowed + int(upto[-1]), lowering + int(upto[127])
            # the substitutions up to the load that the n best of this part reach, block by block
            last = int(np.searchsorted(upto, min(n, upto[-1]))) - 128
            kinds, at = np.nonzero((load <= last) & (ways > 0))
            for low in range(0, len(at), self.block):
                kind, spot = kinds[low : low + self.block], spots[at[low : low + self.block]]
                rows, cols = np.nonzero(self.allowed[codes[spot]] & self.members[kind])
                places, letters, costs, c1, c2 = self.found(codes, spot[rows], cols, first, change1, change2)
                each = np.array([c1 + 0.5 * c2, costs, places, letters, c1, c2], dtype=np.float64)
                if kept.shape[1] == n:
                    # nothing worse than the last one kept can enter
                    each = each[:, (each[0] < kept[0, -1]) | ((each[0] == kept[0, -1]) & (each[1] <= kept[1, -1]))]
                each = np.concatenate([kept, each], axis=1)
                kept = each[:, np.lexsort(each[3::-1])[:n]]
        return allowed, lowering, kept


def substitution_scan(
    df: DataFrame,
    id_col: str,
    sequence_col: str,
    frozen: Iterable[int] = K.FROZEN_POSITIONS,
    residues: str = K.SURFACE_RESIDUES,
    alphabet: str = K.SCAN_ALPHABET,
    cap: float = 5.0,
    single_max: float = K.SINGLE_COST_CAP,
    block: int = 4096,
) -> DataFrame:
    """Every allowed single substitution: id, position, wt, mut, cost, load change.

    Only the windows covering a position are re-scored. Positions are taken in blocks, so a long sequence never
    builds its whole result in memory.
    """
    scanner = _Scan(frozen, residues, alphabet, cap, single_max, block)

    def one(identifier, text: str):
        for places, letters, costs, change1, change2 in scanner.blocks(text):
            yield pd.DataFrame(
                {
                    id_col: identifier,
                    "position": (places + 1).astype(np.int32),
                    "wt": [text[p] for p in places],
                    "mut": scanner.letters[letters],
                    "cost": costs,
                    "load_delta": change1 + 0.5 * change2.astype(np.float64),
                }
            )

    def scan(batches):
        for batch in batches:
            for identifier, text in zip(batch[id_col], batch[sequence_col]):
                yield from one(identifier, text)

    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, position int, wt string, mut string, cost double, load_delta double"
    return df.filter(F.col(sequence_col).isNotNull()).select(id_col, sequence_col).mapInPandas(scan, schema)


def best_substitutions(
    df: DataFrame,
    id_col: str,
    sequence_col: str,
    n: int = 1,
    frozen: Iterable[int] = K.FROZEN_POSITIONS,
    residues: str = K.SURFACE_RESIDUES,
    alphabet: str = K.SCAN_ALPHABET,
    cap: float = 5.0,
    single_max: float = K.SINGLE_COST_CAP,
    block: int = 4096,
) -> DataFrame:
    """One row per text: counts of allowed and of load-lowering substitutions, and the `n` best as an array of structs.

    Best means the lowest load change, then cost, then position and letter. The whole text is scanned as in
    `substitution_scan`, but substitutions are counted by load change and only those that can be best are listed, so the
    output does not grow with positions times letters. change1 and change2 count the windows of either class that come or go. A null text gives nulls.
    """
    scanner = _Scan(frozen, residues, alphabet, cap, single_max, block)
    item = pa.struct(
        [("position", pa.int32()), ("wt", pa.string()), ("mut", pa.string()), ("cost", pa.float64()), ("change1", pa.int32()), ("change2", pa.int32()), ("load_delta", pa.float64())]
    )

    def one(text: str):
        allowed, lowering, kept = scanner.best(text, n)
        best = [
            {"position": int(p) + 1, "wt": text[int(p)], "mut": str(scanner.letters[int(a)]), "cost": c, "change1": int(x), "change2": int(y), "load_delta": d}
            for d, c, p, a, x, y in kept.T.tolist()
        ]
        return allowed, lowering, best

    def scan(batches):
        for batch in batches:
            rows = [(None, None, None) if t is None else one(t) for t in batch.column(1).to_pylist()]
            allowed, lowering, best = zip(*rows) if rows else ((), (), ())
            columns = [pa.array(allowed, pa.int64()), pa.array(lowering, pa.int64()), pa.array(best, pa.list_(item))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, "n_allowed", "n_lowering", "best"])

    id_type = df.schema[id_col].dataType.simpleString()
    fields = "position:int,wt:string,mut:string,cost:double,change1:int,change2:int,load_delta:double"
    schema = f"`{id_col}` {id_type}, n_allowed long, n_lowering long, best array<struct<{fields}>>"
    return df.select(id_col, sequence_col).mapInArrow(scan, schema)
