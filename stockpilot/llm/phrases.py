"""Phrase collocation mining with weighted acyclic automata.

1. ``cuts``: the n-grams' order (language, words) is cut into prefix ranges of
   about equal size.  The cuts come from a sample and only balance the work.
2. ``shards``: each task counts the n-grams of blocks of text (sorted word
   numbers, no row per occurrence) and builds count transducers from the sorted
   n-grams, one per prefix range.
   ``unions``: per range the shards' transducers are united and weights summed;
   n-grams below the least count can't be candidates or parts of one.
3. ``scored``: a range's candidates ask for their parts' counts: the distinct
   parts, as an automaton cut by the same ranges, are composed with the
   transducers of the ranges they fall in, and the counts go back.  A part that
   many candidates share is asked for once a range, so no word is a hot key.
   The questions also carry the largest count of a longer candidate around a
   part, for the drop rule.

Counts and products are exact (Python integers).  Null texts count as empty
and a null language as ``und``; repeated rows count each time; an empty table
gives no rows.  Only the language and the text column are read, other columns
may have any name.  Texts and words may have any length.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockpilot.functions.topk import topk_per_group
from stockpilot.llm.deploy import prepare_workers
from stockpilot.llm.transducer import Transducer, Union, row_order, summed
from stockpilot.session import scratch_path

#: A candidate has two or three words and occurs at least so often.
WORDS, LEAST = 3, 10
#: A candidate inside a longer one that has at least this share (percent) of its count goes.
COVERED = 50
TOP = 2000
#: Words, and bytes of distinct words, that a task counts before it hands their n-grams on.
BLOCK_WORDS, BLOCK_BYTES = 1 << 20, 16 << 20
#: Bytes of text whose n-grams make a prefix range.  The cuts are sent to every task: MAX_RANGES of at most
#: 3 * CUT_BYTES bytes; a larger corpus gets larger ranges.
RANGE_BYTES, MAX_RANGES, CUT_BYTES = 8 << 20, 1 << 17, 32
#: Bytes of text, in expectation, from which the cuts are taken, for all ranges and for each; one in so many
#: of their n-grams goes to the driver.
SAMPLE_BYTES, SAMPLE_STEP = (4 << 20, 1 << 11), 64

_MARK = b"."
_TABLE = bytes(
    ord(_MARK) if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256)
)
_SLICE = 1 << 20


class _Numbers(dict):
    """Numbers of words, from 1 in order of appearance; the mark between pieces of text is 0."""

    def __init__(self):
        super().__init__({_MARK: 0})
        self.bytes = 0

    def __missing__(self, word: bytes) -> int:
        self.bytes += len(word)
        n = self[word] = len(self)
        return n


def numbered(text: bytes, numbers: _Numbers) -> Iterator[np.ndarray]:
    """The numbers of the text's words and marks, a slice of the text at a time."""
    at = 0
    while at < len(text):
        end = at + _SLICE
        while end < len(text) and (cut := max(text.rfind(c, at, end) for c in (b" ", b"\t", b"\n", b"."))) < at:
            end += _SLICE
        end = len(text) if end >= len(text) else cut + 1
        words = text[at:end].translate(_TABLE).replace(_MARK, b" . ").split()
        yield np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        at = end


def _grams(ranks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, counts) of the sorted n-grams of up to three words; 0 separates."""
    some = BLOCK_WORDS  # starts at once, of a longer text; their words fit three to an integer
    for i in range(0, len(ranks), some):
        part = np.append(ranks[i : i + some + 2], [0, 0])
        starts = min(some, len(ranks) - i)
        back, part = np.unique(part, return_inverse=True) if part.max() >= 1 << 21 else (None, part)
        a, b = part[:starts], part[1 : starts + 1]
        c = np.where(b > 0, part[2 : starts + 2], 0)
        key = np.sort((a << 42 | b << 21 | c)[a > 0])
        if not len(key):
            continue
        n = len(key)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        key, counts = key[first], np.diff(np.append(first, n))
        found = [(key[key & 0x1FFFFF > 0], counts[key & 0x1FFFFF > 0])]
        for shift in (21, 42):  # what begins alike, longer or not
            head = key >> shift << shift
            fit = head >> 21 & 0x1FFFFF > 0 if shift == 21 else np.ones(len(head), bool)
            head, sums = head[fit], counts[fit]
            if len(head):
                first = np.flatnonzero(np.append(True, head[1:] != head[:-1]))
                found.append((head[first], np.add.reduceat(sums, first)))
        key, counts = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(key, kind="stable")
        key = key[order]
        rows = np.stack([key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF], axis=1)
        yield rows if back is None else back[rows], counts[order]


def _cut_key(lang: str, labels: list[bytes], row: np.ndarray) -> tuple:
    """What the cuts compare: monotone in the n-gram's order and of bounded size."""
    out: list = [lang]
    for r in row.tolist():
        if not r:
            break
        out.append(labels[r - 1][:CUT_BYTES])
        if len(labels[r - 1]) > CUT_BYTES:
            break
    return tuple(out)


def _cut(lang: str, labels: list[bytes], rows: np.ndarray, bounds: list[tuple]) -> Iterator[tuple[int, int, int]]:
    """(range, begin, end) of the sorted rows."""
    at, n = 0, len(rows)
    while at < n:
        k = bisect.bisect_right(bounds, _cut_key(lang, labels, rows[at]))
        end = n
        if k < len(bounds) and _cut_key(lang, labels, rows[-1]) >= bounds[k]:
            end = bisect.bisect_left(range(n), bounds[k], at, n, key=lambda i: _cut_key(lang, labels, rows[i]))
        yield k, at, end
        at = end


def _batch(schema: pa.Schema, *rows: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _rows(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    lang = F.coalesce(docs[_quoted(lang_col)].cast("string"), F.lit("und")).alias("lang")
    return docs.select(lang, docs[_quoted(text_col)].cast("binary").alias("text"))


def _counted(batches) -> Iterator[tuple[str, list[bytes], np.ndarray, np.ndarray]]:
    """(lang, labels, rows, counts) of the sorted n-grams of blocks of text."""

    def flush(held):
        for lang, (numbers, arrays) in held.items():
            words = list(numbers)[1:]
            order = sorted(range(len(words)), key=words.__getitem__)
            rank = np.zeros(len(words) + 1, np.int64)
            rank[np.array(order, np.int64) + 1] = np.arange(1, len(words) + 1)
            labels = [words[i] for i in order]
            for rows, counts in _grams(rank[np.concatenate(arrays)]):
                yield lang, labels, rows, counts

    held: dict[str, tuple[_Numbers, list]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            numbers, arrays = held.setdefault(lang, (_Numbers(), []))
            for part in numbered(text.as_py() or b"", numbers):
                arrays.append(part)
                size += len(part)
            arrays.append(np.zeros(1, np.int64))
            if size >= BLOCK_WORDS or sum(x.bytes for x, _ in held.values()) >= BLOCK_BYTES:
                yield from flush(held)
                held, size = {}, 0
    yield from flush(held)


def cuts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> list[tuple]:
    """The sorted cuts of the prefix ranges, from a bounded sample of n-grams."""
    prepare_workers(docs.sparkSession)
    rows = _rows(docs, lang_col, text_col)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(MAX_RANGES, -(-total // RANGE_BYTES))
    if ranges < 2:
        return []
    share = min(1.0, max(SAMPLE_BYTES[0], SAMPLE_BYTES[1] * ranges) / total)
    schema = pa.schema([("key", pa.list_(pa.binary()))])

    def some(batches):
        for lang, labels, found, _ in _counted(batches):
            keys = [_cut_key(lang, labels, r) for r in found[SAMPLE_STEP // 2 :: SAMPLE_STEP]]
            if keys:
                yield _batch(schema, *(([k[0].encode(), *k[1:]],) for k in keys))

    keys = rows.filter(F.rand(1) < share).mapInArrow(some, "key array<binary>").collect()
    keys = sorted((bytes(k[0]).decode(), *map(bytes, k[1:])) for (k,) in keys)
    return sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []


def _groups(batches, heads: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Consecutive rows with the same first ``heads`` values; the batches hold sorted rows."""
    import itertools

    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    return itertools.groupby(rows, key=lambda r: r[:heads])


_LINK = "range int, lang string, kind int, peer int, body binary"
_LINK_ARROW = pa.schema([("range", pa.int32()), ("lang", pa.string()), ("kind", pa.int32()), ("peer", pa.int32()), ("body", pa.binary())])


def _dealt(rows: DataFrame, bounds: list[tuple]) -> DataFrame:
    # twice as many tasks as ranges: few ranges share a task
    return rows.repartition(2 * len(bounds) + 2, "range").sortWithinPartitions("range", "lang", "kind", "peer")


def shards(docs: DataFrame, bounds: list[tuple], lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Count transducers of blocks of text, one per prefix range."""
    prepare_workers(docs.sparkSession)

    def run(batches):
        for lang, labels, rows, counts in _counted(batches):
            for k, a, b in _cut(lang, labels, rows, bounds):
                yield _batch(_LINK_ARROW, (k, lang, 0, 0, Transducer.build(labels, rows[a:b], counts[a:b]).to_bytes()))

    return _rows(docs, lang_col, text_col).mapInArrow(run, _LINK)


def unions(parts: DataFrame, bounds: list[tuple], least: int = LEAST) -> DataFrame:
    """One row per range and language: ``body``, the transducer of the n-grams with at least ``least``
    occurrences (null if none), and ``n``, the occurrences of all the range's single words."""
    schema = _LINK_ARROW.append(pa.field("n", pa.int64()))

    def unite(batches):
        for (k, lang), rows in _groups(batches, 2):
            union = Union()
            for *_, blob in rows:
                union.add(Transducer.from_bytes(blob))
            labels, found, counts, n = union.result(least)
            body = Transducer.build(labels, found, counts).to_bytes() if len(found) else None
            yield _batch(schema, (k, lang, 0, 0, body, n))

    return _dealt(parts, bounds).mapInArrow(unite, _LINK + ", n bigint")


def _parts(rows: np.ndarray, counts: np.ndarray):
    """Of sorted n-grams: the candidates' positions; the distinct parts of candidates, sorted; for each
    candidate the numbers of its first and last part by cut (-1: no such cut); for each part the largest
    count of a three-word candidate that it is a two-word part of."""
    at = np.flatnonzero(rows[:, 1] > 0)
    three = rows[at, 2] > 0
    zero = np.zeros(len(at), np.int64)
    r1, r2, r3 = rows[at].T
    sides = [
        np.stack([r1, zero, zero], 1), np.stack([r2, r3, zero], 1),  # after the first word
        np.stack([r1, r2, zero], 1)[three], np.stack([r3, zero, zero], 1)[three],  # after the second
    ]
    every = np.concatenate(sides)
    longer = np.concatenate([zero, np.where(three, counts[at], 0), counts[at][three], zero[three]])
    distinct, _ = summed(every, np.ones(len(every), np.int64))
    number = _numbers_of(distinct, every)
    cover = np.zeros(len(distinct), np.int64)
    np.maximum.at(cover, number, longer)
    first, last = np.full((2, len(at)), -1), np.full((2, len(at)), -1)
    n, m = len(at), int(three.sum())
    first[0], last[0] = number[:n], number[n : 2 * n]
    first[1, three], last[1, three] = number[2 * n : 2 * n + m], number[2 * n + m :]
    return at, distinct, first, last, cover


def _numbers_of(distinct: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each row its number among the sorted distinct rows."""
    both = np.concatenate([distinct, rows])
    order, new = row_order(both)
    out = np.empty(len(both), np.int64)
    out[order] = np.cumsum(new) - 1
    return out[len(distinct) :]


def scored(united: DataFrame, bounds: list[tuple]) -> DataFrame:
    """Every candidate of ``unions``: lang, phrase, a, l, r, score, longest (largest count of a longer
    candidate around it, 0 if none)."""

    def ask(batches):
        for (k, lang), rows in _groups(batches, 2):
            automaton = Transducer.from_bytes(next(rows)[4])
            found, counts, *_ = automaton.paths()
            _, parts, _, _, cover = _parts(found, counts)
            for target, a, b in _cut(lang, automaton.labels, parts, bounds):
                question = Transducer.build(automaton.labels, parts[a:b], cover[a:b] + 1)
                yield _batch(_LINK_ARROW, (target, lang, 1, k, question.to_bytes()))

    def answer(batches):
        for (k, lang), rows in _groups(batches, 2):
            automaton = Transducer.from_bytes(next(rows)[4])
            found, _, head, arc = automaton.paths()
            pairs = np.flatnonzero((found[:, 1] > 0) & (found[:, 2] == 0))  # n-grams of two words, known by their arcs
            pairs = pairs[np.argsort((head << 32 | arc)[pairs])]
            path = (head << 32 | arc)[pairs]
            longest = np.zeros(len(found), np.int64)
            for _, _, _, origin, blob in rows:
                question = Transducer.from_bytes(blob)
                counts, heads, arcs = question.compose(automaton)
                asked, weights, *_ = question.paths()
                two = asked[:, 1] > 0
                at = pairs[np.searchsorted(path, (heads << 32 | arcs)[two])]
                np.maximum.at(longest, at, weights[two] - 1)
                yield _batch(_LINK_ARROW, (origin, lang, 2, k, counts.tobytes()))
            yield _batch(_LINK_ARROW, (k, lang, 3, 0, longest.tobytes()))

    out = pa.schema([("lang", pa.string()), ("phrase", pa.string()), *((c, pa.int64()) for c in ("a", "l", "r", "score", "longest"))])

    def score(batches):
        for (_, lang), rows in _groups(batches, 2):
            automaton = Transducer.from_bytes(next(rows)[4])
            found, counts, *_ = automaton.paths()
            at, _, first, last, _ = _parts(found, counts)
            known, longest = [], None
            for _, _, kind, _, body in rows:
                if kind == 2:
                    known.append(np.frombuffer(body, np.int64))
                else:
                    longest = np.frombuffer(body, np.int64)
            if not len(at):
                continue
            known = np.concatenate(known)
            some: list[tuple] = []
            cols = (found[at], counts[at], known[first].T, known[last].T, first[1] >= 0, longest[at])
            for row, a, l, r, two, most in zip(*(c.tolist() for c in cols)):
                best = min((1_000_000 * a * a // (l[k] * r[k]), k) for k in range(1 + two))
                phrase = b" ".join(automaton.labels[i - 1] for i in row if i).decode()
                some.append((lang, phrase, a, l[best[1]], r[best[1]], best[0], most))
                if len(some) == 1 << 14:
                    yield _batch(out, *some)
                    some = []
            if some:
                yield _batch(out, *some)

    table = united.drop("n").filter(F.col("body").isNotNull())
    questions = table.mapInArrow(ask, _LINK)
    answers = _dealt(table.unionByName(questions), bounds).mapInArrow(answer, _LINK)
    columns = "lang string, phrase string, a bigint, l bigint, r bigint, score bigint, longest bigint"
    return _dealt(table.unionByName(answers), bounds).mapInArrow(score, columns)


def _stored(spark, table: DataFrame, name: str) -> DataFrame:
    path = scratch_path(spark, name)
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """All candidates of a corpus with their scores: the columns of ``scored`` and n, the language's words."""
    spark = docs.sparkSession
    bounds = cuts(docs, lang_col, text_col)
    united = _stored(spark, unions(shards(docs, bounds, lang_col, text_col), bounds, least), "phrase-unions")
    return scored(united, bounds).join(united.groupBy("lang").agg(F.sum("n").alias("n")), "lang")


def best(found: DataFrame, k: int = TOP, covered: int = COVERED) -> DataFrame:
    """The k best candidates of each language that no longer one covers."""
    free = found.filter((F.col("longest") == 0) | (100 * F.col("longest").cast("decimal(38,0)") < covered * F.col("a").cast("decimal(38,0)")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = topk_per_group(free.drop("longest"), ["lang"], order, k, ["phrase"], salts=8)  # the last round ranks 8 * k rows a language at most
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark, sf_dir):
    return best(collocations(spark.read.parquet(f"{sf_dir}/documents.parquet")))


#: The same by counting all n-grams in tables.
ORACLE = r"""
WITH w AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^ \t]+') AS ws
  FROM (SELECT lang, unnest(regexp_split_to_array(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents) AS p
), g AS (
  SELECT lang, phrase, count(*) AS f FROM (
    SELECT lang, unnest(list_transform(range(1, len(ws) + 1), lambda i: ws[i:i])) AS phrase FROM w
    UNION ALL SELECT lang, unnest(list_transform(range(1, len(ws)), lambda i: ws[i:i+1])) FROM w
    UNION ALL SELECT lang, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i:i+2])) FROM w
  ) AS x GROUP BY lang, phrase
), n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE len(phrase) = 1 GROUP BY lang),
c AS (SELECT lang, phrase, f AS a FROM g WHERE len(phrase) > 1 AND f >= 10),
s AS (
  SELECT c.lang, c.phrase, c.a, k.k, x.f AS l, y.f AS r,
         (1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS score
  FROM c JOIN (VALUES (1), (2)) AS k(k) ON k.k < len(c.phrase)
  JOIN g AS x ON x.lang = c.lang AND x.phrase = c.phrase[1:k.k]
  JOIN g AS y ON y.lang = c.lang AND y.phrase = c.phrase[k.k+1:len(c.phrase)]
), b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, part, max(a) AS longest FROM (
    SELECT lang, phrase[1:2] AS part, a FROM c WHERE len(phrase) = 3
    UNION ALL SELECT lang, phrase[2:3], a FROM c WHERE len(phrase) = 3) AS i
  GROUP BY lang, part
), r AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, array_to_string(b.phrase, ' ')) AS rank,
         array_to_string(b.phrase, ' ') AS phrase, b.a::BIGINT AS a, b.l::BIGINT AS l, b.r::BIGINT AS r, b.score::BIGINT AS score
  FROM b LEFT JOIN inside AS i ON i.lang = b.lang AND i.part = b.phrase
  WHERE i.longest IS NULL OR 100 * i.longest < 50 * b.a
)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, n.n, r.score FROM r JOIN n ON n.lang = r.lang WHERE r.rank <= 2000
"""
