"""Quality scores from preference pairs: a Bradley-Terry model over measures of the whole text."""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.shared import discard, store

MAX_DOCS_PER_LABEL = 2000
PAIRS_PER_DOC = 40
KNOTS = 6
RIDGE = 2.0
STEPS = 25
SEED = 11
CUT = 0.7
BLOCK = 1 << 14
SMOOTH = 20

#: classes of bytes, counted alone and as neighbours
CLASSES = ("lower", "upper", "digit", "blank", "line", "comma", "stop", "shout", "symbol", "other", "wide")
UPPER, DIGIT, BLANK, LINE, SYMBOL, OTHER = 1, 2, 3, 4, 8, 9
PAIRS = [(0, 4), (0, 6), (0, 8), (4, 0), (4, 1), (8, 3), (7, 3), (3, 8), (8, 8), (1, 1), (0, 1), (6, 4)]
MEASURES = (
    "words", "word_bytes", "long_words", "short_words", "wordless", "capital_words", "distinct_words", "distinct_pairs", "top_word",
    "same_neighbours", "distinct_lines", "line_words", "packed", "spread", *CLASSES, *(f"{CLASSES[a]}_{CLASSES[b]}" for a, b in PAIRS),
)


def _byte_classes() -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    table[ord("a") : ord("z") + 1] = 0
    table[ord("A") : ord("Z") + 1] = UPPER
    table[ord("0") : ord("9") + 1] = DIGIT
    for kind, letters in ((BLANK, b" \t"), (LINE, b"\n\x0b\x0c\r"), (5, b",;:-'\"()"), (6, b"."), (7, b"!?"), (SYMBOL, b"#*$%&|<>")):
        table[list(letters)] = kind
    table[128:] = len(CLASSES) - 1
    return table


BYTE_CLASS = _byte_classes()


def _blocks(data: bytes):
    """The text in pieces of about `BLOCK` bytes that end between words; one long word stays in one piece."""
    at = 0
    while at < len(data):
        end = at + BLOCK
        if end < len(data):
            cut = max(data.rfind(b" ", at, end), data.rfind(b"\n", at, end))
            if cut < 0:
                later = [p for p in (data.find(b" ", end), data.find(b"\n", end)) if p >= 0]
                cut = min(later, default=len(data) - 1)
            end = cut + 1
        yield data[at:end]
        at = end


def measures(text: str | None) -> np.ndarray:
    """What the model sees of a whole text; null counts as empty.

    Repetition is taken within pieces of about `BLOCK` bytes and added up, so memory is bounded by the longest piece and
    a long text does not look repetitive for its length. Shares are drawn towards 0 for very short texts.
    """
    data = (text or "").encode("utf-8", "surrogatepass")
    words = word_bytes = long_words = short = wordless = capital = distinct = pairs = pair_places = top = same = packed = longest = 0
    lines = distinct_lines = 0
    single = np.zeros(len(CLASSES), np.int64)
    double = np.zeros((len(CLASSES), len(CLASSES)), np.int64)
    for block in _blocks(data):
        kinds = BYTE_CLASS[np.frombuffer(block, np.uint8)]
        both = np.bincount(kinds[:-1].astype(np.int64) * len(CLASSES) + kinds[1:], minlength=len(CLASSES) ** 2)
        single += np.bincount(kinds, minlength=len(CLASSES))
        double += both.reshape(double.shape)
        packed += len(zlib.compress(block, 1))
        found = block.split()
        counts: dict[bytes, int] = {}
        for w in found:
            counts[w] = counts.get(w, 0) + 1
        words += len(found)
        distinct += len(counts)
        top += max(counts.values(), default=0)
        following = list(zip(found, found[1:]))
        pair_places += len(following)
        pairs += len(set(following))
        same += sum(a == b for a, b in following)
        for w, n in counts.items():
            size = len(w)
            word_bytes += n * size
            longest = max(longest, size)
            short += n * (size <= 3)
            long_words += n * (size > 14)
            if w.isupper():
                capital += n * (size > 1)
            elif not w.islower() and w.isascii():
                wordless += n
        rows = [row for row in block.split(b"\n") if row.strip()]
        lines += len(rows)
        distinct_lines += len(set(rows))
    size = len(data)
    share = lambda part, whole: part / (whole + SMOOTH)
    given = single / max(1, size)
    return np.array(
        [
            math.log1p(words), math.log1p(share(word_bytes, words)), share(long_words, words), share(short, words), share(wordless, words),
            share(capital, words), share(words - distinct, words), share(pair_places - pairs, pair_places), share(top, words),
            share(same, words), share(lines - distinct_lines, lines), math.log1p(words / max(1, lines)), share(size - packed, size),
            -float(sum(p * math.log(p) for p in given if p > 0)), *(single / (size + SMOOTH)), *(double[a, b] / (size + SMOOTH) for a, b in PAIRS),
        ]
    )


@dataclass
class Ranking:
    """Bradley-Terry strength of a document: a weighted sum of its measures and of their hinges at knots."""

    centre: np.ndarray
    scale: np.ndarray
    knots: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        hinges = np.maximum(z[:, :, None] - self.knots[None], 0)
        return np.concatenate([z, hinges.reshape(len(z), -1)], axis=1)

    def strength(self, x: np.ndarray) -> np.ndarray:
        # row by row: a matrix product may round otherwise for other numbers of rows
        return (self.features(x) * self.weights).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1: `CUT` at the threshold, so that a score of `CUT` or more means the strength reaches the quantile."""
        z = self.slope * (self.strength(x) - self.threshold) + math.log(CUT / (1 - CUT))
        found = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        # rounding must not move a document across the threshold
        return np.where(z >= math.log(CUT / (1 - CUT)), np.maximum(found, CUT), np.minimum(found, np.nextafter(CUT, 0)))


def preference_pairs(labels: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Preferred and other document of seeded pairs, each document of either label in about `PAIRS_PER_DOC` of them."""
    good, poor = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(good) or not len(poor):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = PAIRS_PER_DOC * max(len(good), len(poor))
    spread = lambda ids: np.concatenate([rng.permutation(ids) for _ in range(-(-n // len(ids)))])[:n]
    return spread(good), spread(poor)


def weighted_quantile(values: np.ndarray, weights: np.ndarray, q: float) -> float:
    """Middle between the two values that the quantile parts; the lowest value for q = 0."""
    order = np.argsort(values, kind="stable")
    total = np.cumsum(weights[order])
    at = int(np.searchsorted(total, q * total[-1] - 1e-9 * total[-1], side="left"))
    below = values[order[min(at, len(order) - 1)]]
    if q <= 0:
        return float(below)
    above = values[order[min(at + 1, len(order) - 1)]]
    return float((below + above) / 2)


def train(x: np.ndarray, labels: np.ndarray, sizes: tuple[int, int], seed: int = SEED) -> Ranking | None:
    """Fit the strengths by Newton steps on the logistic loss of feature differences; None without a label.

    `sizes` are the labelled documents of label 0 and 1 that the rows stand for: the threshold is the quantile of the
    strengths at the share of label 0 among them, which `settle` replaces by that of all documents. Equal inputs give
    equal models.
    """
    if not len(x):
        return None
    rng = np.random.default_rng(seed)
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.clip((x - centre) / scale, -8, 8)
    knots = np.quantile(z, np.linspace(0.05, 0.95, KNOTS), axis=0).T
    model = Ranking(centre, scale, knots, np.zeros(x.shape[1] * (1 + KNOTS)), 0.0, 1.0)
    features = model.features(x)
    win, lose = preference_pairs(labels, rng)
    for _ in range(STEPS if len(win) else 0):
        gradient, curve = RIDGE * model.weights, RIDGE * np.eye(len(model.weights))
        for at in range(0, len(win), 1 << 14):
            gap = features[win[at : at + (1 << 14)]] - features[lose[at : at + (1 << 14)]]
            wrong = 1 / (1 + np.exp(np.clip(gap @ model.weights, -30, 30)))
            gradient = gradient - gap.T @ wrong
            curve = curve + (gap * (wrong * (1 - wrong))[:, None]).T @ gap
        step = np.linalg.solve(curve, gradient)
        model.weights = model.weights - step * min(1.0, 4 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    strength = features @ model.weights
    held = np.where(labels == 1, sizes[1] / max(1, (labels == 1).sum()), sizes[0] / max(1, (labels == 0).sum()))
    model.threshold = weighted_quantile(strength, held, sizes[0] / max(1, sum(sizes)))
    model.slope = 1 / max(1e-6, float(np.abs(strength - model.threshold).mean()) / 2)
    return model


def _measure(rows: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """`keep` columns and the measures of each text as a list of doubles."""
    chosen = rows.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join(f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in keep) + ", measures array<double>"

    def run(batches):
        for batch in batches:
            found = [measures(t.as_py()) for t in batch.column(len(keep))]
            kept = [batch.column(k) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.list_(pa.float64()))], [*keep, "measures"])

    return chosen.mapInArrow(run, schema)


def clean_labels(labels: DataFrame, doc_id: str, label: str) -> DataFrame:
    """(id, label): ids with one and the same label 0 or 1 in all their rows; others are not used."""
    given = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label"))
    given = given.filter("id IS NOT NULL AND label IN (0, 1)").groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most"))
    return given.filter("label = most").select("id", "label")


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> Ranking | None:
    """Model learned from the labelled documents; None if nothing is labelled.

    Every labelled document is measured, counted and takes part in the threshold: the exact quantile of all their
    strengths at the share of label 0. The strengths themselves are fitted on at most about `MAX_DOCS_PER_LABEL` documents
    of each label, chosen by a hash of their ids. The driver gets measures, never texts. An id with several texts gives the
    one with the smallest hash; ids without a label, with both labels or without a document are left out.
    """
    known = clean_labels(labels, doc_id, label)
    given = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    found = _measure(given.filter("id IS NOT NULL"), "text", ["id", "h"]).join(known, "id")
    found = found.groupBy("id", "label").agg(F.min(F.struct("h", "measures"))["measures"].alias("measures"))
    stored = store(found, "measures")
    sizes = {r["label"]: r["n"] for r in stored.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        discard(stored)
        return None
    part = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(SEED)), F.lit(1 << 30))
    wide = F.lit(0.0)
    for kind, n in sorted(sizes.items()):
        wide = F.when(F.col("label") == kind, F.lit(float((1 << 30) * min(1.0, MAX_DOCS_PER_LABEL / n)))).otherwise(wide)
    rows = sorted(stored.filter(part < wide).collect(), key=lambda r: str(r["id"]))
    x = np.array([r["measures"] for r in rows]).reshape(len(rows), len(MEASURES))
    model = train(x, np.array([r["label"] for r in rows]), (sizes.get(0, 0), sizes.get(1, 0)))
    if model is not None:
        model = settle(stored, model, sizes.get(0, 0), sum(sizes.values()))
    discard(stored)
    return model


def settle(measured: DataFrame, model: Ranking, poor: int, n: int) -> Ranking:
    """The model with its threshold between the strengths of ranks `poor` and `poor` + 1 of all `n`, and the slope about it."""

    def strengths(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, len(MEASURES))
                yield pa.RecordBatch.from_arrays([pa.array(model.strength(x))], ["s"])

    stored = store(measured.select("measures").mapInArrow(strengths, "s double"), "strengths")
    below, above = (order_statistic(stored, "s", min(max(rank, 1), n)) for rank in (poor, poor + 1))
    threshold = below if poor == 0 else (below + above) / 2
    gap = stored.agg(F.avg(F.abs(F.col("s") - threshold))).first()[0]
    discard(stored)
    # the order of a sum must not show in the scores
    return replace(model, threshold=threshold, slope=1 / max(1e-6, float(f"{gap:.6g}") / 2))


def order_statistic(df: DataFrame, column: str, rank: int, bins: int = 4096) -> float:
    """The value of that rank (from 1) of a column of finite doubles, exactly: counted in ever narrower ranges."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    skipped, value = 0, F.col(column)
    while low < high:
        place = F.least(F.floor((value - low) / (high - low) * bins), F.lit(bins - 1))
        counted = df.filter(value.between(low, high)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min(value).alias("a"), F.max(value).alias("b"))
        for r in sorted(counted.collect(), key=lambda r: r["bin"]):
            if skipped + r["n"] >= rank:
                low, high = r["a"], r["b"]
                break
            skipped += r["n"]
    return low


def score(docs: DataFrame, model: Ranking | None, text: str = "text") -> DataFrame:
    """The documents with score (0 to 1) and predicted (1 from a score of `CUT`).

    Whole texts are measured; null and empty texts get the score of a text without a word. Without a model every score
    is 0. Columns named like the new ones are replaced, repeated rows get equal answers, an empty table stays empty.
    """
    kept = docs.drop("score", "predicted")
    names = [*kept.columns, "score", "predicted"]
    column = kept.columns.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", score double, predicted int"

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            found = np.zeros(n)
            if model is not None and n:
                found = model.score(np.array([measures(t.as_py()) for t in batch.column(column)]))
            answers = [pa.array(found, pa.float64()), pa.array((found >= CUT).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *answers], names)

    return kept.mapInArrow(run, schema)


def above_quantile(scored: DataFrame, q: float, score: str = "score") -> DataFrame:
    """The scored rows at or above the quantile q of all scores, by a sketch of the whole column (rank error 1/10000).

    Null scores are dropped. One job finds the quantile when this is called.
    """
    cut = scored.agg(F.percentile_approx(score, q, 10000)).first()[0]
    return scored.filter(F.col(score) >= F.lit(cut))
