"""Document quality from a linear-chain conditional random field over lines.

Every line is good (0) or bad (1).  A line's potential is linear in features of
the line and of its neighbours; adjacent lines share a transition potential.
Forward-backward gives each line's marginal; a document's share of good lines,
weighted by their length, is calibrated to a score by a logistic curve.
Lines have no labels of their own: in training they carry their document's.
"""

from __future__ import annotations

import functools
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockpilot.llm.columns import BATCH_CHARS, computed
from stockpilot.llm.shingles import mix

#: Bound of the training sample: documents of each label, and code points of a document.
SAMPLE_PER_LABEL = 2000
SAMPLE_CHARS = 20_000
THRESHOLD = 0.3
FEATURES = 11
NEAR = slice(2, 9)  # the features that neighbours lend
LOWER, UPPER, LETTER, DIGIT, SPACE, MARK, SYMBOL = range(7)


@functools.lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point; those beyond the table are letters."""
    kinds = {"Ll": LOWER, "Lu": UPPER, "Nd": DIGIT, "No": DIGIT, "Nl": DIGIT, "Zs": SPACE, "Zl": SPACE, "Zp": SPACE}
    kinds |= {"Cc": SPACE, "Po": MARK, "Ps": MARK, "Pe": MARK, "Pd": MARK, "Pi": MARK, "Pf": MARK}
    of = [kinds.get(c := unicodedata.category(chr(i)), LETTER if c[0] in "LM" else SYMBOL) for i in range(0x3100)]
    for c in "*#%&@\\":
        of[ord(c)] = SYMBOL
    return np.array([*of, LETTER], np.uint8)


def _line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and lengths of the lines of a text (lines end at newlines)."""
    cp = np.frombuffer((text + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(cp == 10)
    starts = np.append(0, ends[:-1] + 1)
    n = len(ends)
    kind = _classes()[np.minimum(cp, 0x3100)]
    solid = kind != SPACE
    per = lambda mask: np.add.reduceat(mask.astype(np.int64), starts)
    chars = per(solid)
    upper, digits, symbols = per(kind == UPPER), per(kind == DIGIT), per(kind == SYMBOL)
    letters = per(kind <= LETTER)
    head = solid & np.append(True, ~solid[:-1])
    first = np.flatnonzero(head)
    x = np.zeros((n, FEATURES))
    x[:, 0] = 1
    if len(first):
        line = np.searchsorted(ends, first)
        last = np.flatnonzero(solid & np.append(~solid[1:], True))
        plain = kind <= DIGIT
        before = np.maximum(last - 1, 0)
        tail = ~plain[last] & ~plain[before] & (last > first)
        bare = np.add.reduceat((plain & solid).astype(np.int64), first) == 0
        place = np.maximum(np.arange(len(cp)) - first[np.maximum(np.cumsum(head) - 1, 0)], 0)
        code = np.where(solid, mix(cp.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(21))), np.uint64(0))
        word = np.add.reduceat(code, first)
        words = np.bincount(line, minlength=n)
        some = np.maximum(words, 1)
        order = np.lexsort((word, line))
        again = (np.diff(line[order]) == 0) & (np.diff(word[order].astype(np.int64)) == 0)
        repeated = np.bincount(line[order][1:][again], minlength=n)
        twice = np.bincount(line[1:][(word[1:] == word[:-1]) & (line[1:] == line[:-1])], minlength=n)
        x[:, 1] = np.log1p(words) / 5
        x[:, 5] = np.bincount(line[tail], minlength=n) / some
        x[:, 6] = np.bincount(line[bare], minlength=n) / some
        x[:, 7] = repeated / some
        x[:, 8] = twice / some
        x[:, 9] = chars / some / 10
    size = np.maximum(chars, 1)
    x[:, 2] = upper / np.maximum(letters, 1)
    x[:, 3], x[:, 4], x[:, 10] = digits / size, symbols / size, letters / size
    return x, chars


def lines(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Line features with the neighbours' and line lengths.  A very long text
    is read in steps that end at line ends."""
    parts, at = [], 0
    while at <= len(text):
        end = len(text) if len(text) - at <= BATCH_CHARS else text.find("\n", at + BATCH_CHARS)
        end = len(text) if end < 0 else end
        parts.append(_line_features(text[at:end]))
        at = end + 1
    x, size = (np.concatenate(p) for p in zip(*parts))
    none = np.zeros((1, NEAR.stop - NEAR.start))
    return np.hstack([x, np.vstack([none, x[:-1, NEAR]]), np.vstack([x[1:, NEAR], none])]), size


def marginals(u: np.ndarray, sizes: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(line is bad) for chains laid end to end, the expected transition
    counts, and the log partition sum.  ``u``: potentials of bad against good,
    ``t``: 2 x 2 transition potentials.  Chains advance together."""
    order = np.argsort(-sizes, kind="stable")
    start = (np.cumsum(sizes) - sizes)[order]
    size = sizes[order]
    u = np.clip(u, -30, 30)
    psi = np.stack([np.ones_like(u), np.exp(u)], 1)
    m = np.exp(t)
    fore, back, log_z = np.empty_like(psi), np.ones_like(psi), 0.0
    count = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
    for i, c in enumerate(count):
        a = psi[start[:c] + i] if i == 0 else (fore[start[:c] + i - 1] @ m) * psi[start[:c] + i]
        z = a.sum(1, keepdims=True)
        log_z += np.log(z).sum()
        fore[start[:c] + i] = a / z
    pair = np.zeros((2, 2))
    for i in range(len(count) - 1, 0, -1):
        at = start[: count[i]] + i
        b = (psi[at] * back[at]) @ m.T
        joint = fore[at - 1][:, :, None] * m * (psi[at] * back[at])[:, None, :]
        pair += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        back[at - 1] = b / b.sum(1, keepdims=True)
    p = fore * back
    return p[:, 1] / p.sum(1), pair, log_z


@dataclass
class Model:
    weights: np.ndarray
    transitions: np.ndarray
    slope: float
    shift: float

    def good_share(self, texts: list[str]) -> np.ndarray:
        parts = [lines(t) for t in texts]
        sizes = np.array([len(s) for _, s in parts])
        p, _, _ = marginals(np.concatenate([x for x, _ in parts]) @ self.weights, sizes, self.transitions)
        length = np.concatenate([s for _, s in parts]).astype(float)
        at = np.cumsum(sizes) - sizes
        total = np.add.reduceat(length, at)
        return np.where(total > 0, np.add.reduceat(length * (1 - p), at) / np.maximum(total, 1), -1.0)

    def score(self, texts: list[str]) -> np.ndarray:
        """0 to 1, higher for label 1; 0 for a text without a visible character."""
        g = self.good_share(texts)
        return np.where(g < 0, 0.0, 1 / (1 + np.exp(-(self.slope * g + self.shift))))


def fit(texts: list[str], good: list[int], steps: int = 200) -> Model:
    """Maximum conditional likelihood by Adam, then the logistic curve."""
    width = FEATURES + 2 * (NEAR.stop - NEAR.start)
    if not texts or len(set(good)) < 2:  # nothing to tell apart
        share = float(np.mean(good)) if texts else 0.5
        return Model(np.zeros(width), np.zeros((2, 2)), 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    parts = [lines(t) for t in texts]
    x, sizes = np.concatenate([p for p, _ in parts]), np.array([len(s) for _, s in parts])
    bad = 1 - np.array(good)
    y = np.repeat(bad, sizes)
    stay = np.array([[(sizes - 1)[bad == 0].sum(), 0], [0, (sizes - 1)[bad == 1].sum()]], float)
    theta, v, s = np.zeros(width + 4), np.zeros(width + 4), np.zeros(width + 4)
    for step in range(1, steps + 1):
        p, pair, _ = marginals(x @ theta[:width], sizes, theta[width:].reshape(2, 2))
        g = np.append((y - p) @ x, (stay - pair).ravel()) / len(y) - 1e-4 * theta
        v, s = 0.9 * v + 0.1 * g, 0.99 * s + 0.01 * g * g
        theta = theta + 0.1 * (v / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    model = Model(theta[:width], theta[width:].reshape(2, 2), 1.0, 0.0)
    share = model.good_share(texts)
    a, b = 1.0, 0.0
    g, label = np.maximum(share, 0), 1 - bad
    for _ in range(50):  # Newton's method with a small prior on the slope
        q = 1 / (1 + np.exp(-(a * g + b)))
        w = q * (1 - q) + 1e-9
        grad = np.array([((label - q) * g).sum() - 0.01 * a, (label - q).sum()])
        hess = np.array([[(w * g * g).sum() + 0.01, (w * g).sum()], [(w * g).sum(), w.sum()]])
        da, db = np.linalg.solve(hess, grad)
        a, b = a + np.clip(da, -5, 5), b + np.clip(db, -5, 5)
    model.slope, model.shift = float(a), float(b)
    return model


def held_out(id_col: Column) -> Column:
    """Rows that are never learnt from; a row without id may not be learnt from either."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on a sample of at most SAMPLE_PER_LABEL documents of each label, of
    at most SAMPLE_CHARS code points each, drawn by a hash of the id from the
    rows whose crc32(doc_id) mod 5 is not 0; of rows that share an id, one."""
    rows = labels.select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("__good"))
    rows = rows.filter("__good in (0, 1)").filter(~held_out(F.col("__id")))
    rows = rows.groupBy("__id").agg(F.min("__good").alias("__good"))
    drawn = None
    for label in (0, 1):
        some = rows.filter(F.col("__good") == label).orderBy(F.xxhash64("__id"), "__id").limit(SAMPLE_PER_LABEL)
        drawn = some if drawn is None else drawn.unionByName(some)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    texts = texts.filter(F.length("__text") <= SAMPLE_CHARS).join(F.broadcast(drawn), "__id")
    texts = texts.groupBy("__id", "__good").agg(F.min("__text").alias("__text"))  # an id may repeat without bound
    got = sorted(texts.toLocalIterator(), key=lambda r: (r[0], r[2]))
    return fit([r[2] for r in got], [r[1] for r in got])


def with_quality(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` and ``__score`` per input row: null and empty texts score 0,
    repeated rows alike; an empty table gives no rows."""
    return computed(docs, text_col, lambda: lambda texts: [model.score(texts).tolist()], {"__score": pa.float64()}, keep)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_quality(docs, model, ["doc_id"]).select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out"),
        F.col("__score").alias("score"),
        (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"),
    )
