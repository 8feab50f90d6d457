"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting visits the features in turn; each visit fits a shallow tree to the residual on that feature's bins and
adds it, shrunk, to the feature's lookup table. Then the pairs of features that explain most of what is left get tables
of their own. A document's score is a sum of table entries, which numpy adds up for a whole batch at once.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import positional, restored
from tessera.llm.supervised import THRESHOLD, TRAIN_ROWS, remainder, score_all, scored_column, sigmoid, training_rows

FEATURES = (
    "log_chars", "log_words", "mean_word", "long_words", "distinct_words", "top_word", "repeated_next", "symbols", "digits",
    "capitals", "lines_per_word", "one_word_lines", "repeated_lines", "sentence_ends", "exclamations", "compressed",
)
#: Bytes that the compression feature looks at in one piece, over the whole text piece by piece.
_PIECE = 1 << 16
_ALNUM = bytes(c for c in range(128) if chr(c).isalnum())
_SPACE_ETC = b" \n\t\r.,;:'\"()-"


def _one(text: str) -> tuple[float, ...]:
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return (np.log1p(chars),) + (0.0,) * (len(FEATURES) - 1)
    raw = text.encode("utf-8", "surrogatepass")
    ascii_only = raw.translate(None, bytes(range(128, 256)))
    symbols = len(ascii_only.translate(None, _ALNUM + _SPACE_ETC))
    capitals = sum(map(str.isupper, words))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    packed = sum(len(zlib.compress(raw[i : i + _PIECE], 1)) for i in range(0, len(raw), _PIECE))
    return (
        np.log1p(chars), np.log1p(n), sum(map(len, words)) / n, sum(len(w) > 20 for w in words) / n, len(counts) / n, max(counts.values()) / n,
        sum(map(str.__eq__, words, words[1:])) / n, symbols / chars, len(ascii_only) and (len(ascii_only) - len(ascii_only.translate(None, b"0123456789"))) / chars,
        capitals / n, len(lines) / n, sum(len(x.split(None, 1)) == 1 for x in lines) / len(lines), 1 - len(set(lines)) / len(lines),
        sum(w[-1] in ".!?" for w in words) / n, text.count("!") / n, packed / len(raw),
    )


def features(texts: list[str]) -> np.ndarray:
    return np.array([_one(t) for t in texts], dtype=np.float64).reshape(len(texts), len(FEATURES))


@dataclass
class Additive:
    """Lookup tables: ``edges[f]`` cuts feature f into bins, ``tables[f]`` has a value for each; pairs alike on coarse bins."""

    base: float
    edges: list
    tables: list
    coarse: list
    pairs: list

    def bins(self, x: np.ndarray, edges: list) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)], axis=1) if len(x) else np.zeros((0, len(edges)), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        fine = self.bins(x, self.edges)
        for f, table in enumerate(self.tables):
            z += table[fine[:, f]]
        if self.pairs:
            c = self.bins(x, self.coarse)
            for f, g, table in self.pairs:
                z += table[c[:, f], c[:, g]]
        return sigmoid(z)


def _cuts(x: np.ndarray, n: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, n + 1)[1:-1], method="nearest"))


def _leaf(g, h):
    return g / (h + 1.0)


def _shallow(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of up to three leaves over ordered bins: two greedy cuts, each where the gain is largest."""
    bounds = [0, len(g)]
    for _ in range(2):
        best = (1e-9, None)
        for a, b in zip(bounds, bounds[1:], strict=False):
            if b - a < 2:
                continue
            cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
            left_g, left_h, all_g, all_h = cg[:-1], ch[:-1], cg[-1], ch[-1]
            gain = left_g**2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1) - all_g**2 / (all_h + 1)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], a + k + 1)
        if best[1] is None:
            break
        bounds = sorted({*bounds, best[1]})
    out = np.empty(len(g))
    for a, b in zip(bounds, bounds[1:], strict=False):
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a two-way table into four: (gain, leaf values)."""
    best = (0.0, np.zeros_like(g))
    for i in range(1, g.shape[0]):
        for j in range(1, g.shape[1]):
            out, gain = np.empty_like(g), 0.0
            for rows in (slice(0, i), slice(i, None)):
                for cols in (slice(0, j), slice(j, None)):
                    a, b = g[rows, cols].sum(), h[rows, cols].sum()
                    out[rows, cols] = _leaf(a, b)
                    gain += a * a / (b + 1)
            if gain > best[0]:
                best = (gain, out)
    return best


def fit(x: np.ndarray, y: np.ndarray, *, rounds: int = 120, rate: float = 0.15, fine: int = 32, coarse: int = 6, pairs: int = 4, pair_rounds: int = 20) -> Additive:
    """Deterministic. Without both labels among ``y`` every score is the label's share (0.5 without rows)."""
    share = float(np.clip(y.mean(), 0.02, 0.98)) if len(y) else 0.5
    width = x.shape[1]
    model = Additive(float(np.log(share / (1 - share))), [_cuts(x[:, f], fine) if len(y) else np.array([]) for f in range(width)], [], [_cuts(x[:, f], coarse) if len(y) else np.array([]) for f in range(width)], [])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if not len(y) or y.min() == y.max():
        return model
    b = model.bins(x, model.edges)
    z = np.full(len(y), model.base)
    for _ in range(rounds):
        for f, table in enumerate(model.tables):
            p = sigmoid(z)
            step = rate * _shallow(np.bincount(b[:, f], y - p, len(table)), np.bincount(b[:, f], p * (1 - p), len(table)))
            table += step
            z += step[b[:, f]]
    c = model.bins(x, model.coarse)
    sizes = [len(e) + 1 for e in model.coarse]

    def two_way(f, g):
        p, at = sigmoid(z), c[:, f] * sizes[g] + c[:, g]
        n = sizes[f] * sizes[g]
        return np.bincount(at, y - p, n).reshape(sizes[f], sizes[g]), np.bincount(at, p * (1 - p), n).reshape(sizes[f], sizes[g])

    ranked = sorted(((_quadrants(*two_way(f, g))[0], f, g) for f in range(width) for g in range(f)), reverse=True)[:pairs]
    for _, f, g in ranked:
        model.pairs.append((f, g, np.zeros((sizes[f], sizes[g]))))
    for _ in range(pair_rounds):
        for f, g, table in model.pairs:
            step = rate * _quadrants(*two_way(f, g))[1]
            table += step
            z += step[c[:, f], c[:, g]]
    return model


def learn(docs: DataFrame, labels: DataFrame, *, rows: int = TRAIN_ROWS) -> Additive:
    """Fits on at most ``rows`` labelled documents whose crc32(doc_id) mod 5 is not 0; only their features reach the driver."""
    sample = training_rows(docs, labels, "quality", lambda i: remainder(i, 5) != 0, rows=rows)

    def run(batches):
        for b in batches:
            yield b.assign(x=list(features(b["text"].tolist()))).drop(columns="text")

    got = sample.mapInPandas(run, "id bigint, y int, x array<double>").toPandas().sort_values("id", kind="stable")
    x = np.array(got["x"].tolist(), dtype=np.float64).reshape(len(got), len(FEATURES))
    return fit(x, got["y"].to_numpy(dtype=np.float64))


def quality_scores(docs: DataFrame, labels: DataFrame, *, rows: int = TRAIN_ROWS) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted.

    Null texts count as empty, and empty texts are scored like others. Rows with a null id aren't held out. Repeated rows
    each get the same score. Labels other than 0 and 1 are ignored; of several labels of a document the largest holds.
    Columns of ``docs`` other than the id and the text aren't read.
    """
    model = learn(docs, labels, rows=rows)
    return score_all(docs, lambda texts: model.score(features(texts)), lambda i: remainder(i, 5) == 0)


def accepted(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns.

    Null and empty texts are scored like others, repeated rows alike, and null ids stay or go by their texts. An empty table
    gives none. Columns may have any names; a text goes to Python once, and only its score comes back.
    """
    model = learn(docs, labels, **options)
    named, at = positional(docs)
    good = scored_column(lambda texts: model.score(features(texts)), F.col(at["text"])) >= THRESHOLD
    return restored(named.where(good), at)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """``quality_scores`` of all documents; odd rows as stated there."""
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
