"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
A word's probability in a language is the sum over all its segmentations into
pieces (forward algorithm); a text's is the product over its words.  The piece
probabilities are fitted by expectation-maximisation, with the same forward
sums and their backward counterparts, on a bounded sample of labelled rows.
"""

from __future__ import annotations

import functools
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockpilot.llm.columns import BATCH_CHARS, computed
from stockpilot.llm.deploy import prepare_workers

#: Bound of the training sample: documents a language (in expectation), and code points of a document.
SAMPLE_PER_LANG = 400
SAMPLE_CHARS = 200_000
EM_STEPS = 4
#: Longer runs of letters are computed one by one, with sums that are scaled again and again;
#: only for training they are cut into runs of this length.
WORD_CHARS = 32
#: Distinct words whose probabilities a worker remembers.
REMEMBERED = 400_000
#: Letters of the remembered words.
REMEMBERED_CHARS = 8_000_000
UNKNOWN = "und"
#: Letters from which on a text's fit is judged; the floor is FIT_MARGIN (nats a letter) below the lowest
#: FIT_SHARE of the learnt texts.
FIT_LETTERS, FIT_SHARE, FIT_MARGIN = 60, 0.01, 0.5
START = "▁"  # the vocabulary's mark of a word's start


def _not_letters() -> str:
    r"""Ranges of the characters of \w that are neither letters nor decimal digits (fractions, circled numbers)."""
    odd = [c for c in range(sys.maxunicode + 1) if (s := chr(c)).isalnum() and not s.isalpha() and not s.isdecimal()]
    first = [c for i, c in enumerate(odd) if not i or odd[i - 1] != c - 1]
    last = [c for i, c in enumerate(odd) if i + 1 == len(odd) or odd[i + 1] != c + 1]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(first, last))


_ODD = _not_letters()
_WORDS = re.compile(r"[^\W\d_]+")  # faster, and the same for nearly all texts
_LETTERS, _OTHER = re.compile(rf"[^\W\d_{_ODD}]+"), re.compile(rf"[\W\d_{_ODD}]")


def words(text: str, cut: bool = False) -> list[str]:
    """Runs of letters, lower-cased; with ``cut`` cut into runs of at most WORD_CHARS."""
    found = _WORDS.findall(text.lower())
    if not all(map(str.isalpha, found)):
        found = _LETTERS.findall(text.lower())
    if cut and any(len(w) > WORD_CHARS for w in found):
        found = [w[i : i + WORD_CHARS] for w in found for i in range(0, len(w), WORD_CHARS)]
    return found


@functools.lru_cache(maxsize=1)
def vocabulary(path: str | None = None) -> dict[str, int]:
    """Lower-case pieces of letters of the vocabulary file, numbered from 1; number 0 is
    any single character without a piece."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    fit = (p for p in pieces if (b := p.removeprefix(START)).lower() == b and (not b or _LETTERS.fullmatch(b)))
    return {p: i for i, p in enumerate(fit, 1)}


def steps(text: str, chars: int) -> Iterator[str]:
    """The text in steps of about ``chars``, which end at a non-letter."""
    at = 0
    while at < len(text):
        m = _OTHER.search(text, at + chars)
        stop = m.start() if m else len(text)
        yield text[at:stop]
        at = stop


def lattice(some: list[str], pieces: dict[str, int]) -> np.ndarray:
    """Piece numbers of words of one length: [word, end, piece length - 1], -1 where there is none."""
    n = len(some[0]) + 1
    most = min(n, max(map(len, pieces)))
    out = np.full((len(some), n, most), -1, np.int32)
    get = pieces.get
    for i, w in enumerate(some):
        s, row = START + w, out[i]
        for a in range(n):
            row[a, 0] = get(s[a], 0)
            for k in range(2, min(most, n - a) + 1):
                if (p := get(s[a : a + k])) is not None:
                    row[a + k - 1, k - 1] = p
    return out


def forward(arcs: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Sums over the segmentations of each prefix: [word, end, language].  The last row of ``prob`` is zero."""
    w, n, most = arcs.shape
    a = np.zeros((w, n + 1, prob.shape[1]))
    a[:, 0] = 1
    for end in range(1, n + 1):
        for k in range(1, min(end, most) + 1):
            a[:, end] += a[:, end - k] * prob[arcs[:, end - 1, k - 1]]
    return a


def log_forward(word: str, pieces: dict[str, int], prob: np.ndarray) -> np.ndarray:
    """Log of the sum over all segmentations of a word of any length, by language.
    The sums of the last prefixes, as many as the longest piece has letters, are kept."""
    s, most, get = START + word, max(map(len, pieces)), pieces.get
    last, log = np.zeros((most, prob.shape[1])), np.zeros(prob.shape[1])  # of prefix e at e % most
    last[0] = 1
    for end in range(1, len(s) + 1):
        at, ids = [(end - 1) % most], [get(s[end - 1], 0)]
        for k in range(2, min(end, most) + 1):
            if (p := get(s[end - k : end])) is not None:
                at.append((end - k) % most)
                ids.append(p)
        new = (last[at] * prob[ids]).sum(0)
        last[end % most] = new
        if end % 8 == 0:
            scale = last.max(0)
            last /= scale
            log += np.log(scale)
    return log + np.log(last[len(s) % most])


def expected(arcs: np.ndarray, prob: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected piece counts [piece, language] of words that occur ``weight`` [word, language] times."""
    w, n, most = arcs.shape
    a, b = forward(arcs, prob), np.zeros((w, n + 1, prob.shape[1]))
    b[:, n] = 1
    for at in range(n - 1, -1, -1):
        for k in range(1, min(n - at, most) + 1):
            b[:, at] += prob[arcs[:, at + k - 1, k - 1]] * b[:, at + k]
    share = weight / np.maximum(a[:, n], 1e-300)
    count = np.zeros_like(prob)
    for end in range(1, n + 1):
        for k in range(1, min(end, most) + 1):
            ids = arcs[:, end - 1, k - 1]
            np.add.at(count, ids, a[:, end - k] * prob[ids] * b[:, end] * share)
    return count


@dataclass
class Model:
    langs: list[str]
    log_prob: np.ndarray  # float32 [piece, language]
    path: str | None = None
    #: By language: texts of the language have at least this log-probability a letter.
    floor: dict[str, float] = field(default_factory=dict)
    known: dict = field(default_factory=dict)

    def __getstate__(self):
        return {"langs": self.langs, "log_prob": self.log_prob, "path": self.path, "floor": self.floor, "known": {}}

    def _learn(self, words_: set[str]) -> None:
        """Log-probabilities of the words, new ones computed together."""
        new = [w for w in words_ if w not in self.known]
        self.chars = sum(map(len, new)) + (self.chars if self.known else 0)
        if not self.known or len(self.known) + len(new) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.known.clear()
            new = list(words_)
            self.chars = sum(map(len, new))
            self.table = np.zeros((max(REMEMBERED, len(new)), len(self.langs)))
            self.prob = np.vstack([np.exp(self.log_prob.astype(float)), np.zeros(len(self.langs))])
        pieces, by_length = vocabulary(self.path), {}
        for w in new:
            by_length.setdefault(len(w), []).append(w)
        for n, same in by_length.items():
            if n > WORD_CHARS:
                for w in same:
                    self.table[len(self.known)] = log_forward(w, pieces, self.prob)
                    self.known[w] = len(self.known)
                continue
            for i in range(0, len(same), 4096):
                some = same[i : i + 4096]
                at = len(self.known)
                self.table[at : at + len(some)] = np.log(np.maximum(forward(lattice(some, pieces), self.prob)[:, -1], 1e-300))
                self.known.update(zip(some, range(at, at + len(some))))

    def _sum(self, some: list[str]) -> np.ndarray:
        return self.table[np.fromiter(map(self.known.__getitem__, some), np.int64, len(some))].sum(0)

    def log_likelihoods(self, texts: list[str]) -> list[np.ndarray | None]:
        """Per text the log-probability by language; None for a text without
        letters.  A text longer than BATCH_CHARS is taken in steps of about that size."""
        if len(texts) == 1 and len(texts[0]) > BATCH_CHARS:
            total = None
            for step in steps(texts[0], BATCH_CHARS):
                if some := words(step):
                    self._learn(set(some))
                    total = self._sum(some) if total is None else total + self._sum(some)
            return [total]
        found = [words(t) for t in texts]
        self._learn(set().union(*found))
        return [self._sum(some) if some else None for some in found]

    def fits(self, texts: list[str]) -> tuple[list[str], list[float], list[float | None]]:
        """``predict`` and, for texts of at least FIT_LETTERS letters, the log-probability
        a letter in the predicted language, less the language's floor: below 0 the text is
        like none of the texts that the language was learnt from."""
        found = self.log_likelihoods(texts) if self.langs else [None] * len(texts)
        langs, scores = self._chosen(found)
        fits: list[float | None] = []
        for text, lang, x in zip(texts, langs, found):
            n = sum(map(len, words(text)))
            fits.append(float(x[self.langs.index(lang)]) / n - self.floor.get(lang, -np.inf) if x is not None and n >= FIT_LETTERS else None)
        return langs, scores, fits

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and its posterior probability under equal priors."""
        return self._chosen(self.log_likelihoods(texts) if self.langs else [None] * len(texts))

    def _chosen(self, found: list[np.ndarray | None]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for x in found:
            if x is None:
                langs.append(UNKNOWN)
                scores.append(0.0)
            else:
                i = int(np.argmax(x))
                langs.append(self.langs[i])
                scores.append(float(1 / np.exp(x - x[i]).sum()))
        return langs, scores


def fit(counts: dict[str, dict[str, int]], path: str | None = None, steps: int = EM_STEPS) -> Model:
    """``counts``: occurrences of each word by language."""
    langs = sorted(counts)
    pieces = vocabulary(path)
    if not langs:
        return Model([], np.zeros((len(pieces) + 1, 0), np.float32), path)
    by_length: dict[int, list[str]] = {}
    for w in sorted({w for c in counts.values() for w in c}):
        by_length.setdefault(len(w), []).append(w)
    steps_of = [same[i : i + 4096] for same in by_length.values() for i in range(0, len(same), 4096)]
    weights = [np.array([[counts[g].get(w, 0) for g in langs] for w in some], float) for some in steps_of]
    lattices = [lattice(some, pieces) for some in steps_of]
    size = len(pieces) + 1
    prob = np.vstack([np.full((size, len(langs)), 1 / size), np.zeros(len(langs))])
    for _ in range(steps):
        count = sum((expected(a, prob, w) for a, w in zip(lattices, weights)), np.zeros_like(prob))[:size]
        shared = (count.sum(1, keepdims=True) + 0.1) / (count.sum() + 0.1 * size)
        count += 5.0 * shared + 0.01  # towards all languages together
        prob[:size] = count / count.sum(0)
    return Model(langs, np.log(prob[:size]).astype(np.float32), path)


def held_out(id_col: Column) -> Column:
    """Rows that are never learnt from; a row without id may not be learnt from either."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on about SAMPLE_PER_LANG documents of each language, of at most
    SAMPLE_CHARS code points, drawn by a hash of id and text from the rows with a
    language whose crc32(doc_id) mod 4 is not 2.  Only their word counts per
    language reach the driver."""
    prepare_workers(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & ~held_out(F.col("id")))
    share = {r[0]: min(1.0, SAMPLE_PER_LANG / r[1]) for r in rows.groupBy("lang").count().collect()}
    if not share:
        return fit({})
    # by the text too: rows that share an id are drawn each on its own
    draw = F.pmod(F.xxhash64("id", "text", F.lit(5)), F.lit(1 << 20)) / (1 << 20)
    picked = functools.reduce(lambda a, b: a | b, ((F.col("lang") == g) & (draw < p) for g, p in share.items()))
    rows = rows.filter(picked & (F.length("text") <= SAMPLE_CHARS))

    def count(batches):
        for batch in batches:
            langs, found = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                some = words(text.as_py() or "", cut=True)
                langs += [lang] * len(some)
                found += some
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.string())], ["lang", "word"])

    counts = rows.select("lang", "text").mapInArrow(count, "lang string, word string").groupBy("lang", "word").count()
    by_lang: dict[str, dict[str, int]] = {g: {} for g in share}
    for lang, word, n in counts.toLocalIterator():
        by_lang[lang][word] = n
    model = fit({g: c for g, c in by_lang.items() if c})

    def judge(batches):
        for batch in batches:
            langs, found = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                got, _, (x,) = model.fits([text])
                if x is not None and got == [lang]:
                    langs.append(lang)
                    found.append(x if np.isfinite(x) else None)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.float64())], ["lang", "x"])

    model.floor = dict.fromkeys(model.langs, 0.0)
    low = rows.select("lang", "text").mapInArrow(judge, "lang string, x double").groupBy("lang")
    model.floor = {r[0]: r[1] - FIT_MARGIN for r in low.agg(F.percentile_approx("x", FIT_SHARE, 10_000)).collect() if r[1] is not None}
    return model


def with_language(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", fit: bool = False) -> DataFrame:
    """``keep``, ``__lang`` and ``__score`` per input row, repeated rows alike; a
    text that is null or has no letter is UNKNOWN with score 0; an empty table
    gives no rows.  With ``fit`` also ``__fit`` (``Model.fits``)."""

    def make():
        return lambda texts: (model.fits if fit else model.predict)(texts)

    fields = {"__lang": pa.string(), "__score": pa.float64()} | ({"__fit": pa.float64()} if fit else {})
    return computed(docs, text_col, make, fields, keep)


def op9_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return with_language(docs, train(docs), ["doc_id"]).select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).alias("held_out"),
        F.col("__lang").alias("lang_pred"),
        F.col("__score").alias("score"),
    )
