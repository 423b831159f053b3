"""Language identification by a byte convolutional network trained in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 12
MAX_DOCS = 2400
MAX_DOCS_PER_LANG = 400
MAX_LANGS = 512
WINDOWS_PER_DOC = 6
EPOCHS = 8
BATCH = 64
RATE = 0.004
SEED = 5
APPLY_WINDOWS = 512
ROWS = 256


@dataclass
class Network:
    """Byte embedding, one filter bank per width, and the softmax layer over the largest responses of a window."""

    labels: list[str]
    embed: np.ndarray
    banks: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.banks, *self.biases, self.out, self.out_bias]


def windows_of(data: bytes, size: int = WINDOW) -> np.ndarray:
    """All windows of a text, (n, size) bytes: consecutive, the last one padded with zero bytes."""
    n = max(1, -(-len(data) // size))
    return np.frombuffer(data.ljust(n * size, b"\0"), np.uint8).reshape(n, size)


def new_network(labels: list[str], rng: np.random.Generator) -> Network:
    return Network(
        labels,
        rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32),
        [rng.normal(0, (2 / (w * EMBEDDING)) ** 0.5, (w, EMBEDDING, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(labels))).astype(np.float32),
        np.zeros(len(labels), np.float32),
    )


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _gradients(net: Network, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean cross entropy over a batch of windows, in the order of `parameters`."""
    n, size = x.shape
    e = net.embed[x]
    pooled, places, stacked = [], [], []
    for bank, bias in zip(net.banks, net.biases):
        w = bank.shape[0]
        slices = np.concatenate([e[:, k : size - w + 1 + k] for k in range(w)], axis=2)
        z = slices @ bank.reshape(-1, FILTERS)
        at = z.argmax(axis=1)
        top = np.take_along_axis(z, at[:, None], 1)[:, 0] + bias
        pooled.append(top)
        places.append(at)
        stacked.append(slices)
    hidden = np.maximum(np.concatenate(pooled, axis=1), 0)
    error = _softmax(hidden @ net.out + net.out_bias)
    error[np.arange(n), y] -= 1
    error /= n
    back = (error @ net.out.T) * (hidden > 0)
    d_embed = np.zeros_like(net.embed)
    d_banks, d_biases = [], []
    for k, (bank, at, slices) in enumerate(zip(net.banks, places, stacked)):
        w = bank.shape[0]
        d = back[:, k * FILTERS : (k + 1) * FILTERS]
        rows = np.arange(n)[:, None]
        inputs = slices[rows, at]
        d_banks.append(np.einsum("nf,nfi->if", d, inputs).reshape(w, EMBEDDING, FILTERS))
        d_biases.append(d.sum(axis=0))
        into = d[:, :, None, None] * bank.transpose(2, 0, 1)[None]
        for j in range(w):
            np.add.at(d_embed, x[rows, at + j].ravel(), into[:, :, j].reshape(-1, EMBEDDING))
    return [d_embed, *d_banks, *d_biases, hidden.T @ error, error.sum(axis=0)]


def training_windows(text: str) -> np.ndarray:
    """Windows spread over the whole text; a short last one counts only where it is the only one."""
    data = text.encode("utf-8")
    found = windows_of(data)
    full = found[:-1] if len(found) > 1 and len(data) % WINDOW else found
    return full[np.unique(np.linspace(0, len(full) - 1, min(WINDOWS_PER_DOC, len(full))).astype(int))]


def train(texts: list[str], labels: list[str], seed: int = SEED) -> Network | None:
    """Fit the network to labelled texts; see `train_windows`."""
    return train_windows([training_windows(t) for t in texts], labels, seed)


def train_windows(windows: list[np.ndarray], labels: list[str], seed: int = SEED) -> Network | None:
    """Fit the network to windows of labelled texts by Adam; None without a text. Equal inputs give equal networks."""
    known = sorted(set(labels))
    if not known:
        return None
    rng = np.random.default_rng(seed)
    net = new_network(known, rng)
    x = np.concatenate(windows)
    y = np.repeat([known.index(label) for label in labels], [len(w) for w in windows])
    if len(known) == 1:
        return net
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            picked = order[at : at + BATCH]
            part = x[picked].copy()
            # texts end anywhere: blank the tail of some windows, so that short texts look familiar
            for row in np.flatnonzero(rng.random(len(part)) < 0.25):
                part[row, rng.integers(16, WINDOW) :] = 0
            step += 1
            for p, g, (m, v) in zip(net.parameters(), _gradients(net, part, y[picked]), state):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


class Applier:
    """The network on many windows at once. A filter's response is a sum over bytes, so it is looked up per byte pair."""

    def __init__(self, net: Network):
        self.net = net
        self.tables = []
        for bank in net.banks:
            single = np.einsum("be,kef->kbf", net.embed, bank)
            parts = []
            for k in range(0, bank.shape[0] - 1, 2):
                parts.append((k, True, (single[k][:, None] + single[k + 1][None]).reshape(65536, FILTERS)))
            if bank.shape[0] % 2:
                parts.append((bank.shape[0] - 1, False, single[-1]))
            self.tables.append(parts)

    def responses(self, x: np.ndarray) -> np.ndarray:
        """Largest response of every filter in every window."""
        n, size = x.shape
        wide = x.astype(np.uint16)
        pairs = (wide[:, :-1] << 8) | wide[:, 1:]
        out = []
        for bank, bias, parts in zip(self.net.banks, self.net.biases, self.tables):
            length = size - bank.shape[0] + 1
            total = None
            for k, double, table in parts:
                found = table[(pairs if double else x)[:, k : k + length]]
                total = found if total is None else np.add(total, found, out=total)
            out.append(total.max(axis=1) + bias)
        return np.maximum(np.concatenate(out, axis=1), 0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate(
            [_softmax(self.responses(x[at : at + APPLY_WINDOWS]) @ self.net.out + self.net.out_bias) for at in range(0, len(x), APPLY_WINDOWS)]
        )


def _sample(docs: DataFrame, text: str, lang: str, doc_id: str) -> tuple[list[np.ndarray], list[str]]:
    """Windows of at most `MAX_DOCS_PER_LANG` texts of each of the `MAX_LANGS` languages with most documents, `MAX_DOCS` in all.

    Chosen by a hash of id and text, so by no order of the table. The hash first thins a language to about four times
    what it may give, in every task; only that is ranked. Windows are cut in the tasks, so no whole text reaches the driver.
    """
    usable = docs.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(lang).cast("string").alias("lang"), F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), text).alias("h"), F.col(text).alias("text")
    )
    narrow = usable.select("lang", "h")
    top = narrow.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS)
    share = F.pmod(F.xxhash64("h"), F.lit(1 << 30)) * F.col("n")
    thinned = narrow.join(F.broadcast(top), "lang").filter(share <= 4 * MAX_DOCS_PER_LANG * (1 << 30)).select("lang", "h")
    ranked = thinned.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    picked = ranked.filter(F.col("rank") <= MAX_DOCS_PER_LANG).orderBy("rank", "lang").limit(MAX_DOCS).select("lang", "h")

    def cut(batches):
        for batch in batches:
            found = [training_windows(t.as_py()).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["lang", "h", "windows"])

    chosen = usable.join(F.broadcast(picked), ["lang", "h"]).select("lang", "h", "text").mapInArrow(cut, "lang string, h long, windows binary")
    rows = chosen.dropDuplicates(["lang", "h"]).collect()
    rows.sort(key=lambda r: (r["lang"], r["h"]))
    return [np.frombuffer(r["windows"], np.uint8).reshape(-1, WINDOW) for r in rows], [r["lang"] for r in rows]


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Network | None:
    """Network trained on a bounded sample of the labelled rows; null labels and texts without a letter are left out."""
    return train_windows(*_sample(docs, text, lang, doc_id))


def has_letter(text: str | None) -> bool:
    """Whether some character is a letter (Unicode categories L); numbers, marks and signs such as ² or ½ are none."""
    return any(map(str.isalpha, text or ""))


def predict_texts(apply: Applier | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Label and score of whole texts; all windows of all texts are judged together and averaged by their bytes."""
    labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    rows = [r for r, t in enumerate(texts) if has_letter(t)]
    if apply is None:
        return labels, scores
    held: list[tuple[int, np.ndarray, int]] = []
    size = 0

    def judge():
        nonlocal held, size
        p = apply.probabilities(np.concatenate([w for _, w, _ in held]))
        at = 0
        for r, w, n in held:
            weights = np.full(len(w), WINDOW, np.float64)
            weights[-1] = n - WINDOW * (len(w) - 1)
            mean = weights @ p[at : at + len(w)] / weights.sum()
            at += len(w)
            best = int(mean.argmax())
            labels[r], scores[r] = apply.net.labels[best], float(min(1.0, max(0.0, mean[best])))
        held, size = [], 0

    for r in rows:
        data = texts[r].encode("utf-8")
        found = windows_of(data)
        held.append((r, found, len(data)))
        size += len(found)
        if size >= 4 * APPLY_WINDOWS:
            judge()
    if held:
        judge()
    return labels, scores


def identify(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """The documents with lang_pred and score.

    Whole texts are cut into windows of `WINDOW` bytes, the network judges each, and the document gets the mean. Texts
    that are null or have no letter get 'und' and 0, and so does everything if there was nothing to learn from. Columns
    named like the new ones are replaced; repeated rows get equal answers; an empty table gives an empty result.
    """
    kept = docs.drop("lang_pred", "score")
    names = [*kept.columns, "lang_pred", "score"]
    column = names.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", lang_pred string, score double"

    def run(batches):
        apply = Applier(net) if net else None
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            labels, scores = predict_texts(apply, batch.column(column).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names)

    return kept.mapInArrow(run, schema)


def remainder(doc_id: str | Column, by: int) -> Column:
    """crc32 of the id as text modulo a number; null ids count as empty text."""
    name = F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))
    return F.crc32(name.cast("binary")) % by
