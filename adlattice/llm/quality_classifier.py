"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features describe the line and its neighbours; the
chain couples neighbouring lines. A document's score is the mean of its lines'
forward-backward marginals for good, weighted by their length.

Only documents are labelled, so line labels are latent. The field is first fitted with
each line taking its document's label; then lines of bad documents that look good by
themselves count as good by half, up to half of a document's text, and the field is
fitted again, so that it learns where good and bad lines meet. The sample of labelled
documents is bounded by their number and by their lines; its texts are learned whole, long
ones as several chains. Only features of that sample reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Bounds of the training sample: documents, and the lines of all of them together.
TRAIN_DOCS, TRAIN_LINES = 4000, 400_000
CHAIN = 200  # lines of a chain in training; longer texts are several, one after another
THRESHOLD = 0.7

_SYMBOLS = b"#*$%&|<>"
_ASCII_UP = bytes(range(65, 91))
_ASCII_LOW = bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_ENDS = frozenset(b".!?:;")
OWN = 13
NEIGHBOUR = (1, 2, 3, 4, 7)  # features taken from the lines before and after
WIDTH = OWN + 2 * len(NEIGHBOUR)


def _line(raw: bytes, seen: set[bytes]) -> tuple[float, ...]:
    """Features of one line; seen: the document's lines before it."""
    n = len(raw)
    words = raw.split()
    w = len(words)
    if not w:
        return (1.0, *[0.0] * (OWN - 1))
    left = lambda drop: n - len(raw.translate(None, drop))
    symbols, up, low, digits = left(_SYMBOLS), left(_ASCII_UP), left(_ASCII_LOW), left(_DIGITS)
    letters = up + low + 1
    marks = raw.count(b"!") + raw.count(b"?")
    repeated = raw in seen
    seen.add(raw)
    return (
        1.0,
        min(symbols / w, 3.0),
        up / letters,
        min(marks / w, 2.0),
        len(set(words)) / w,
        float(words[-1][-1] in _ENDS),
        np.log1p(w) if w < 32 else 3.5,
        float(repeated),
        min(raw.count(b".") / w, 1.0),
        min(n / w, 20.0) / 10.0,
        digits / n,
        min(raw.count(b"|") / w, 1.0),
        float(w < 3),
    )


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x WIDTH features, lines' weights); a null text is one empty line."""
    seen: set[bytes] = set()
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    own = np.array([_line(x, seen) for x in lines], dtype=np.float64)
    near = own[:, NEIGHBOUR]
    none = np.zeros((1, len(NEIGHBOUR)))
    x = np.concatenate([own, np.concatenate([none, near[:-1]]), np.concatenate([near[1:], none])], axis=1)
    return x, np.array([len(line) + 1.0 for line in lines])


def _logsum(a: np.ndarray) -> np.ndarray:
    top = a.max(axis=-1, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=-1, keepdims=True)))[..., 0]


def marginals(emit: np.ndarray, sizes: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For padded chains: marginals for good (chains x lines), log partition sums, and
    the expected transitions. emit is the score of good over bad, by chain and line."""
    n, most = emit.shape
    scores = np.stack([np.zeros_like(emit), emit], axis=2)
    live = np.arange(most)[None, :] < sizes[:, None]
    alpha = np.zeros((n, most, 2))
    alpha[:, 0] = scores[:, 0]
    for i in range(1, most):
        step = _logsum(alpha[:, i - 1, None, :] + trans.T[None]) + scores[:, i]
        alpha[:, i] = np.where(live[:, i, None], step, alpha[:, i - 1])
    total = _logsum(alpha[:, -1])
    beta = np.zeros((n, most, 2))
    pairs = np.zeros((2, 2))
    for i in range(most - 2, -1, -1):
        ahead = trans[None] + (scores[:, i + 1] + beta[:, i + 1])[:, None, :]
        on = live[:, i + 1]
        if on.any():
            pairs += np.exp(alpha[on, i, :, None] + ahead[on] - total[on, None, None]).sum(axis=0)
        beta[:, i] = np.where(on[:, None], _logsum(ahead), 0.0)
    good = 1.0 / (1.0 + np.exp(np.clip((alpha[..., 0] + beta[..., 0]) - (alpha[..., 1] + beta[..., 1]), -500, 500)))
    return good * live, total, pairs


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(r) for r in rows])
    out = np.zeros((len(rows), sizes.max(), *rows[0].shape[1:]))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out, sizes


def line_labels(own: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """How good the lines of a bad document are taken to be, from their own scores of good
    over bad: half, where good is likelier, but not for the worst lines that make up
    half of the text."""
    order = np.argsort(own, kind="stable")
    worst = int(np.searchsorted(np.cumsum(weights[order]), weights.sum() / 2)) + 1
    good = own > 0
    good[order[:worst]] = False
    return 0.5 * good


def fit(rows: list[np.ndarray], labels: np.ndarray, weights: list[np.ndarray] | None = None, steps: tuple[int, ...] = (150, 80), rate: float = 0.1, ridge: float = 1e-3) -> dict:
    """Weights by gradient ascent (Adam) on the mean log likelihood of whole chains, once
    with the documents' labels and then with lines' labels; a document counts the same
    whatever its length, and both labels alike."""
    if not rows or len(set(labels.tolist())) < 2:  # nothing to tell apart: every line at the base rate
        share = float(np.mean(labels)) if len(labels) else 0.5
        w = np.zeros(WIDTH)
        w[0] = np.log((share + 1e-3) / (1 - share + 1e-3))
        return {"w": w, "trans": np.zeros((2, 2)), "mean": np.zeros(WIDTH), "scale": np.ones(WIDTH)}
    weights = [np.ones(len(x)) for x in rows] if weights is None else weights
    every = np.concatenate(rows)
    mean, scale = every.mean(axis=0), every.std(axis=0) + 1e-6
    mean[0], scale[0] = 0.0, 1.0
    rows = [(x - mean) / scale for x in rows]
    lines = [np.full(len(x), float(y)) for x, y in zip(rows, labels, strict=True)]
    order = np.argsort([len(x) for x in rows])
    share = labels.mean()
    theta = np.zeros(WIDTH + 4)
    for stage, n in enumerate(steps):
        if stage:
            for i in np.flatnonzero(labels == 0):
                lines[i] = line_labels(rows[i] @ theta[:WIDTH], weights[i])
        groups = []
        for at in range(0, len(order), 256):
            pick = order[at : at + 256]
            x, sizes = padded([rows[i] for i in pick])
            y, _ = padded([lines[i] for i in pick])
            a, b = (z[np.arange(x.shape[1] - 1)[None, :] < sizes[:, None] - 1] for z in (y[:, :-1], y[:, 1:]))
            met = np.array([[((1 - a) * (1 - b)).sum(), ((1 - a) * b).sum()], [(a * (1 - b)).sum(), (a * b).sum()]])
            weight = np.where(labels[pick] > 0, 0.5 / share, 0.5 / (1 - share)) / (len(rows) * sizes)
            groups.append((x, sizes, y, met, weight))
        m, v = 0.0, 0.0
        for t in range(1, n + 1):
            grad = -ridge * theta
            for x, sizes, y, met, weight in groups:
                good, _, pairs = marginals(x @ theta[:WIDTH], sizes, theta[WIDTH:].reshape(2, 2))
                live = np.arange(x.shape[1])[None, :] < sizes[:, None]
                grad[:WIDTH] += np.einsum("nl,nld->d", (y - good) * live * weight[:, None], x)
                grad[WIDTH:] += ((met - pairs) / max(1.0, sizes.sum())).ravel() * len(sizes) / len(rows)
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return {"w": theta[:WIDTH], "trans": theta[WIDTH:].reshape(2, 2), "mean": mean, "scale": scale}


def chains(n: int) -> list[slice]:
    """A document's n lines as chains that are trained on; together they are all of it."""
    return [slice(at, at + CHAIN) for at in range(0, n, CHAIN)]


def held_out(doc_id: str) -> Column:
    """Rows whose crc32(doc_id as text) mod 4 is 2; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, most_lines: int = TRAIN_LINES) -> dict:
    """The model from a sample of labelled rows that aren't held out: those with the smallest
    hashes of doc_id, at most `most` of them, as far as all their lines are at most
    `most_lines`; a row that would exceed that is passed over. Their texts are learned
    whole. A doc_id with several labels counts with their mean's side.

    Null labels and doc_ids take no part; a null text is one empty line; of repeated
    documents all rows up to the bounds are taken. Without rows, or with one label only,
    every text scores at the base rate. Only doc_id, text and quality are read.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("_good"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most `most` rows
    lines = rows.select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("lines"))
    lines = lines.orderBy(F.xxhash64("doc_id"), "doc_id", "lines").limit(most).groupBy("doc_id").agg(F.sum("lines").alias("lines"))
    taken, left = [], most_lines
    for r in lines.orderBy(F.xxhash64("doc_id"), "doc_id").collect():  # two numbers for each row of the sample
        if r.lines <= left:
            taken.append((r.doc_id,))
            left -= r.lines
    if taken:
        rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame(taken, docs.select("doc_id").schema)), "doc_id")

    def run(parts: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for part in parts:
            made = [features(t) for t in part["text"]]
            yield {
                "doc_id": part["doc_id"],
                "good": part["_good"],
                "x": [[x[r].astype("<f4").tobytes() for r in chains(len(x))] for x, _ in made],
                "w": [[w[r].astype("<f4").tobytes() for r in chains(len(w))] for _, w in made],
            }

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = map_rows(rows.select("doc_id", "text", "_good"), run, f"doc_id {kind}, good int, x array<binary>, w array<binary>")
    got = got.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("x")).limit(most).collect()
    pieces = [(r.good, x, w) for r in got for x, w in zip(r.x, r.w, strict=True)]
    x = [np.frombuffer(x, "<f4").reshape(-1, WIDTH).astype(np.float64) for _, x, _ in pieces]
    return fit(x, np.array([g for g, _, _ in pieces], dtype=int), [np.frombuffer(w, "<f4").astype(np.float64) for _, _, w in pieces])


def score_texts(texts: list[str | None], model: dict) -> list[float]:
    made = [features(t) for t in texts]
    order = np.argsort([len(w) for _, w in made], kind="stable")
    out = np.zeros(len(made))
    for at in range(0, len(order), 64):
        pick = order[at : at + 64]
        x, sizes = padded([(made[i][0] - model["mean"]) / model["scale"] for i in pick])
        weights, _ = padded([made[i][1] for i in pick])
        good, _, _ = marginals(x @ model["w"], sizes, model["trans"])
        out[pick] = (good * weights).sum(axis=1) / weights.sum(axis=1)
    return np.clip(out, 0.0, 1.0).tolist()


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score and predicted for every row. A null or empty text is one
    empty line; repeated rows score alike; only doc_id and text are read. Whole texts are
    scored, of any length; an empty table gives no rows."""

    def run(parts: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for part in parts:
            yield {"doc_id": part["doc_id"], "score": score_texts(part["text"], model)}

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = map_rows(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
