"""Quality classifier: a small byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into cells of CELL bytes. Learned filters slide over windows
of 8 embedded bytes, 4 bytes apart; their activations are averaged over chunks of two
neighbouring cells, so chunks overlap by half and together cover the whole text. A plane
of its own tells how well a chunk repeats itself at its best lag, which linear filters
can't see. A hidden layer reads each chunk, its units are max-pooled over all chunks, and
the pooled units are combined into one probability.

The network is fitted on the driver on at most ``sample`` labelled rows, half from each
class where there are enough, chosen by a hash of the id; scoring reads every whole text, a
long one in parts whose units are max-pooled together.

Cases: null and empty texts are one empty chunk and get the score the network gives it.
Rows with a null id are scored and never used for fitting. Labels other than 0 and 1, null
labels and labels without a document are ignored; a document labelled more than once counts with its
largest label. Without labelled rows of both classes every score is the labels' mean, or
0.5 without labels, and nothing is predicted to be bad below that. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a cell, of a filter's step, of an embedding, filters, hidden units, lags that are compared.
CELL, STEP, EMBED, FILTERS, HIDDEN = 128, 4, 4, 16, 16
LAGS = range(2, 25)
#: Bytes that are fitted on or scored at a time; a longer text is scored in parts.
BLOCK = 1 << 20
Buffer = bytes | np.ndarray


@dataclass
class Network:
    """Parameters by name; ``prior`` is the score where nothing could be learned."""

    weights: dict[str, np.ndarray] | None
    prior: float = 0.5


def pack(texts: Sequence[Buffer]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, each padded with zeros to whole cells; first cell of each text and the end)."""
    cells = [max(1, -(-len(t) // CELL)) for t in texts]
    starts = np.concatenate([[0], np.cumsum(cells)])
    data = np.zeros(int(starts[-1]) * CELL, np.uint8)
    for t, s in zip(texts, starts.tolist(), strict=False):
        data[s * CELL : s * CELL + len(t)] = np.frombuffer(t, np.uint8) if len(t) else 0
    return data, starts


def _chunks(per_cell: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each cell with its successor in the same text; a text's last cell stands alone."""
    out = per_cell.copy()
    inner = np.ones(len(per_cell), bool)
    inner[starts[1:] - 1] = False
    at = np.flatnonzero(inner)
    out[at] += per_cell[at + 1]
    return out


def repetition(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each chunk, 4 times the largest share of bytes that equal the byte some lag before them.

    Chunks of less than half a cell count as half a cell. The factor brings the plane to the scale of the filters' averages.
    """
    real = data != 0
    size = _chunks(real.reshape(-1, CELL).sum(1, dtype=np.float32), starts)
    best = np.zeros(len(size), np.float32)
    first = (starts[:-1] * CELL)[:, None]
    for lag in LAGS:
        same = np.zeros(len(data), bool)
        np.equal(data[lag:], data[:-lag], out=same[lag:])
        same &= real
        # A text's first bytes have no byte of their own so far before them.
        same[first + np.arange(lag)] = False
        best = np.maximum(best, _chunks(same.reshape(-1, CELL).sum(1, dtype=np.float32), starts))
    return 4 * best / np.maximum(size, CELL // 2)


def _tables(w: dict[str, np.ndarray]) -> np.ndarray:
    """What a byte adds to the filters at each of a window's 8 places: embedding and filters folded, summed in fixed order."""
    blocks = np.concatenate([w["first"], w["second"]]).reshape(2 * STEP, EMBED, FILTERS)
    out = np.zeros((2 * STEP, 256, FILTERS), w["embed"].dtype)
    for k in range(EMBED):
        out += w["embed"][None, :, k, None] * blocks[:, None, k]
    return out


def _forward(w: dict[str, np.ndarray], data: np.ndarray, starts: np.ndarray, repeats: np.ndarray, train: bool = True) -> dict[str, np.ndarray]:
    """Looked-up rows and columns are added one after the other, so that no sum depends on what else is in the batch."""
    cells = len(data) // CELL
    steps = CELL // STEP
    places = data.reshape(-1, STEP)
    tables = _tables(w)
    z = np.repeat(w["bias"][None], len(places), 0)
    for k in range(STEP):
        z += tables[k][places[:, k]]
    behind = np.append(places[1:], places[:1], 0)
    last = starts[1:] * steps - 1  # a text's last step has no successor
    for k in range(STEP):
        row = tables[STEP + k][behind[:, k]]
        row[last] = 0
        z += row
    a = np.maximum(z, 0)
    filled = (data.reshape(cells, steps, STEP)[:, :, 0] != 0).astype(np.float32)
    size = np.maximum(_chunks(filled.sum(1), starts), 1)[:, None]
    pooled = _chunks((a.reshape(cells, steps, -1) * filled[:, :, None]).sum(1), starts) / size
    v = np.concatenate([pooled, repeats[:, None]], 1)
    u = np.repeat(w["hidden_bias"][None], cells, 0)
    for k in range(v.shape[1]):
        u += v[:, k, None] * w["hidden"][k]
    h = np.maximum(u, 0)
    x = w["embed"][data].reshape(-1, STEP * EMBED) if train else None
    return {"x": x, "z": z, "filled": filled, "size": size, "v": v, "u": u, "h": h}


def _next(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each step's successor in the same text; zeros behind a text's last step."""
    out = np.concatenate([x[1:], np.zeros_like(x[:1])])
    out[starts[1:] * (CELL // STEP) - 1] = 0
    return out


def _probability(w: dict[str, np.ndarray], top: np.ndarray) -> np.ndarray:
    """Of each text, from its pooled units."""
    logit = (top * w["out"]).sum(1) + w["out_bias"]
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _gradient(w: dict[str, np.ndarray], data: np.ndarray, starts: np.ndarray, f: dict[str, np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross-entropy."""
    n, cells, steps = len(y), len(data) // CELL, CELL // STEP
    top = np.maximum.reduceat(f["h"], starts[:-1])
    d = ((_probability(w, top) - y) / n).astype(np.float32)
    g = {"out": top.T @ d, "out_bias": d.sum()}
    text = np.repeat(np.arange(n), np.diff(starts))
    winner = (f["h"] == top[text]) & (f["u"] > 0)
    share = winner / np.maximum(np.add.reduceat(winner.astype(np.float32), starts[:-1])[text], 1)
    du = (share * (d[:, None] * w["out"])[text]).astype(np.float32)
    g["hidden"], g["hidden_bias"] = f["v"].T @ du, du.sum(0)
    dv = (du @ w["hidden"].T)[:, :FILTERS] / f["size"]
    # A cell counts in its own chunk and in that of the cell before it.
    dc = dv.copy()
    inner = np.ones(cells, bool)
    inner[starts[:-1]] = False
    at = np.flatnonzero(inner)
    dc[at] += dv[at - 1]
    dz = (dc[:, None, :] * f["filled"][:, :, None]).reshape(cells * steps, -1) * (f["z"] > 0)
    g["first"], g["bias"] = f["x"].T @ dz, dz.sum(0)
    g["second"] = _next(f["x"], starts).T @ dz
    dx = dz @ w["first"].T
    dz[starts[1:] * steps - 1] = 0  # a text's last step has no successor
    dx[1:] += dz[:-1] @ w["second"].T
    dx = dx.reshape(-1, EMBED)
    g["embed"] = np.stack([np.bincount(data, dx[:, k], 256) for k in range(EMBED)], 1).astype(np.float32)
    return g


def fit(texts: list[bytes], labels: list[int], epochs: int = 20, batch: int = 32, rate: float = 0.01, seed: int = 0) -> Network:
    """A network for the probability of label 1, by Adam on shuffled batches."""
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return Network(None, float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    normal = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
    w = {
        "embed": normal(256, EMBED) * 0.5,
        "first": normal(STEP * EMBED, FILTERS) * 0.25,
        "second": normal(STEP * EMBED, FILTERS) * 0.25,
        "bias": np.zeros(FILTERS, np.float32),
        "hidden": normal(FILTERS + 1, HIDDEN) * 0.5,
        "hidden_bias": np.zeros(HIDDEN, np.float32),
        "out": normal(HIDDEN) * 0.5,
        "out_bias": np.zeros((), np.float32),
    }
    # Each class weighs half, whatever the sample holds.
    m = {k: np.zeros_like(v) for k, v in w.items()}
    s = {k: np.zeros_like(v) for k, v in w.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        at = 0
        while at < len(order):
            sizes = np.cumsum([len(texts[j]) for j in order[at : at + batch]])
            part = order[at : at + max(1, int(np.searchsorted(sizes, BLOCK, "right")))]
            at += len(part)
            data, starts = pack([texts[j] for j in part])
            f = _forward(w, data, starts, repetition(data, starts))
            g = _gradient(w, data, starts, f, y[part])
            step += 1
            pace = rate * (1 - epoch / epochs)
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                s[k] = 0.99 * s[k] + 0.01 * g[k] ** 2
                w[k] = (w[k] - pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return Network(w)


def _windows(n_bytes: int) -> Iterator[tuple[int, int, int, int]]:
    """Parts of a text that are scored at a time: (first and end byte, first and end of the cells whose chunks they give).

    The cell before holds what its bytes are compared with; the two behind complete the last chunk and its last filter.
    """
    cells, each = max(1, -(-n_bytes // CELL)), BLOCK // CELL
    for at in range(0, cells, each):
        a, b = max(0, at - 1), min(cells, at + each + 2)
        yield a * CELL, min(n_bytes, b * CELL), at - a, min(cells, at + each) - a


def scores(net: Network, texts: Sequence[Buffer]) -> np.ndarray:
    """Probability of label 1 of each whole text; it depends on that text alone."""
    if net.weights is None or not len(texts):
        return np.full(len(texts), net.prior)
    top = np.full((len(texts), HIDDEN), -np.inf, np.float32)
    held: list[tuple[int, Buffer, int, int]] = []
    size = 0

    def close() -> None:
        data, starts = pack([part for _, part, _, _ in held])
        h = _forward(net.weights, data, starts, repetition(data, starts), train=False)["h"]
        for (k, _, a, b), start in zip(held, starts.tolist(), strict=False):
            top[k] = np.maximum(top[k], h[start + a : start + b].max(0))

    for k, text in enumerate(texts):
        for a, b, first, end in _windows(len(text)):
            if held and size + b - a > BLOCK:
                close()
                held, size = [], 0
            held.append((k, text[a:b], first, end))
            size += b - a
    close()
    return _probability(net.weights, top).astype(np.float64)


def _buffers(texts: pa.Array) -> list[np.ndarray]:
    """The bytes of each text, not copied; null counts as empty."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].tolist()
    whole = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return [whole[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def held_out(id_col: str) -> Column:
    """Rows that are never used for fitting: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 1200, id_col: str = "doc_id", text_col: str = "text", longest: int = 1 << 18, most_bytes: int = 1 << 25
) -> Network:
    """A network fitted on at most ``sample`` labelled rows that aren't held out.

    longest: bytes of a text that may be fitted on; most_bytes: of all these texts together, the smallest by a hash of the id come first.
    Of texts that share an id the shortest is taken, of these the one with the smallest digest.
    """
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(label).cast("int").alias("y"))
    )
    spread = F.xxhash64("id", F.lit(11))
    half = max(1, sample // 2)
    # At most ``sample`` rows, so they can be broadcast, and their sizes and texts brought to the driver.
    some = known.where("y = 1").orderBy(spread, "id").limit(half).union(known.where("y = 0").orderBy(spread, "id").limit(half)).withColumn("place", spread)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sized = texts.join(F.broadcast(some), "id").select("id", "place", F.octet_length("text").alias("n"), F.md5("text").alias("digest"))
    rows = sized.groupBy("id", "place").agg(F.min(F.struct("n", "digest")).alias("best")).where(F.col("best.n") <= longest).select("id", "place", "best.*").collect()
    rows.sort(key=lambda r: (r["place"], r["id"]))
    sums = np.cumsum([r["n"] for r in rows])
    taken = rows[: int(np.searchsorted(sums, most_bytes, "right"))]
    chosen = docs.sparkSession.createDataFrame([(r["id"], r["digest"]) for r in taken], f"id {dict(texts.dtypes)['id']}, digest string")
    found = texts.join(F.broadcast(some.join(chosen, "id")), "id").where(F.md5("text") == F.col("digest")).select("id", "y", "text").dropDuplicates(["id"]).collect()
    found.sort(key=lambda r: r["id"])
    return fit([r["text"].encode() for r in found], [r["y"] for r in found])


def with_score(docs: DataFrame, net: Network, name: str = "score", text_col: str = "text") -> DataFrame:
    """docs with the column ``name``: the probability of label 1 of each whole text."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(scores(net, _buffers(texts)))

    return docs.withColumn(name, score(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 1200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, score, predicted (1 where the score is at least 0.5)."""
    net = train(docs, labels, label, sample, id_col, text_col)
    rows = with_score(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), net, text_col="text")
    return rows.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
