"""Spelling variant grouping by asymmetric q-chunks.

Words one edit apart are found without comparing all words:

1. ``word_counts``: the corpus's words and their occurrences, counted inside
   each task first.
2. ``near_pairs``: one word (the shorter; of equal lengths either) contributes
   disjoint chunks, the other its positional grams.  Two chunks cover the word,
   so one edit leaves one whole; the half that the edit is in is cut into two
   chunks again (three times from 16 code points on), so that a join key holds
   3/4 (7/8) of the word and common beginnings or ends make no large groups.
   What stands before the edit keeps its place and what stands after it moves
   by the difference of lengths: grams are joined within shift one.
   Candidates are verified by edit distance, each pair under one key only.
3. ``variants``: per word its near words' number, its form (the near word of
   largest count, if that is ``ratio`` times the word's) and its root (forms
   followed to the last; a step multiplies the count, so chains are short).

Null texts have no words; a null id counts as the empty string; repeated rows
count each time; ties of counts go to the smaller word in code-point order;
an empty table gives no rows.  Only the id and the text column are read, other
columns may have any name.  Words of any length are handled whole.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockpilot.llm.deploy import prepare_workers
from stockpilot.session import ensure_checkpoint_dir

LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: One run in so many, by the checksum of id and run, loses a code point.
DAMAGE = 31
#: Distinct words and their bytes that a task counts before it hands them on.
HELD_WORDS, HELD_BYTES = 200_000, 16 << 20
#: From this length on a word is cut into eight parts instead of four.
LONG_WORD = 16
#: Longer parts are compared by their first difference, as the built-in edit distance takes quadratic time.
LONG_PART = 64


def damaged(doc_id: bytes, run: bytes, every: int) -> bytes:
    """The lower-cased run without the code point that its checksum names, if it names one."""
    h = zlib.crc32(run, zlib.crc32(doc_id + b":"))
    if every and h % every == 0:
        chars = run.decode()
        at = h % len(chars)
        return (chars[:at] + chars[at + 1 :]).encode()
    return run


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH, every: int = DAMAGE) -> DataFrame:
    """(word, n) over the runs of Latin letters of the texts, A-Z lower-cased,
    of at least ``least`` code points after the damage."""
    prepare_workers(docs.sparkSession)
    rows = docs.select(docs[_quoted(id_col)].cast("string").alias("id"), docs[_quoted(text_col)].alias("text"))

    def run(batches):
        runs = re.compile(f"[A-Za-zÀ-ÿ]{{{least},}}")  # greedy: maximal runs that are long enough
        held: dict[bytes, int] = {}
        size = 0
        for batch in batches:
            for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                doc = (doc or "").encode()
                for found in runs.findall(text or ""):
                    word = damaged(doc, found.encode().lower(), every)
                    if word in held:
                        held[word] += 1
                        continue
                    held[word] = 1
                    size += len(word)
                    if len(held) >= HELD_WORDS or size >= HELD_BYTES:
                        yield from _counted(held, least)
                        held, size = {}, 0
        yield from _counted(held, least)

    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _counted(held: dict[bytes, int], least: int):
    words = [w.decode() for w in held]
    keep = [i for i, w in enumerate(words) if len(w) >= least]
    n = list(held.values())
    for i in range(0, len(keep), 1 << 16):
        some = keep[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array([words[k] for k in some], pa.string()), pa.array([n[k] for k in some], pa.int64())], names=["word", "n"])


def _keys(words: DataFrame, shift: int) -> DataFrame:
    """A row per word and part of it: the key is all but that part.  With shift
    1 the word is the longer one: it is cut where a word shorter by one is, the
    part holds one code point more and what follows stands one place later."""
    length = F.col("len") - shift
    parts = F.when(length >= LONG_WORD, 8).otherwise(4)
    cut = words.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    before = F.floor(F.col("part") * length / parts).cast("int")
    after = F.floor((F.col("part") + 1) * length / parts).cast("int")
    cut = cut.withColumns({"at": before, "next": after + shift})
    return cut.select(
        F.xxhash64("part", length, F.expr("substring(word, 1, at)"), F.expr("substring(word, next + 1)")).alias("key"),
        "part", "at", (F.col("next") - F.col("at")).alias("size"), "word", "n", F.lit(shift).alias("shift"),
    )


def near_pairs(words: DataFrame) -> DataFrame:
    """Every pair of (word, n) rows with words one insertion, deletion or
    replacement apart, once: (x, nx, y, ny), x the shorter or the smaller.
    Words are distinct."""
    words = words.select("word", "n", F.char_length("word").alias("len"))
    x = _keys(words, 0)
    y = _keys(words, 0).unionByName(_keys(words.filter(F.col("len") > 1), 1))
    # The hint is on purpose: the planner can't see how many rows the explosion makes.
    pairs = x.alias("x").hint("merge").join(y.alias("y").hint("merge"), (F.col("x.key") == F.col("y.key")) & (F.col("x.part") == F.col("y.part")))
    same = (F.col("y.shift") == 0) & (F.col("x.word") < F.col("y.word"))
    # A code point inserted into a row of equal ones fits several parts: the first that fits counts.
    earlier = F.expr("substring(x.word, x.at + 1) = substring(y.word, x.at + 2)")
    longer = (F.col("y.shift") == 1) & ((F.col("x.part") == 0) | ~earlier)
    # What the key holds is equal (compared, as it is a hash); so the parts must be one edit apart.
    rest = "substring(x.word, 1, x.at) = substring(y.word, 1, y.at) AND substring(x.word, x.at + x.size + 1) = substring(y.word, y.at + y.size + 1)"
    px, py = "substring(x.word, x.at + 1, x.size)", "substring(y.word, y.at + 1, y.size)"
    first = f"array_position(zip_with(split({px}, ''), split({py}, ''), (a, b) -> NOT a <=> b), true)"
    by_first = f"substring({px}, cast({first} + 1 - y.shift AS int)) = substring({py}, cast({first} + 1 AS int))"
    edited = F.when(F.col("x.size") <= LONG_PART, F.expr(f"levenshtein({px}, {py}, 1) = 1")).otherwise(F.expr(by_first))
    pairs = pairs.filter((same | longer) & F.expr(rest) & edited)
    return pairs.select(F.col("x.word").alias("x"), F.col("x.n").alias("nx"), F.col("y.word").alias("y"), F.col("y.n").alias("ny"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form) by pointer doubling: after k rounds 2 ** k steps are followed."""
    found = forms.select("word", F.col("form").alias("root")).checkpoint()
    while True:
        on = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        found = found.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")).checkpoint()
        if found.filter("moved").isEmpty():
            return found.drop("moved")
        found = found.drop("moved")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of distinct (word, n) rows."""
    ensure_checkpoint_dir(words.sparkSession)
    words = words.select("word", "n").checkpoint()
    both = F.explode(F.array(
        F.struct(F.col("x").alias("word"), F.col("y").alias("near"), F.col("ny").alias("near_n")),
        F.struct(F.col("y").alias("word"), F.col("x").alias("near"), F.col("nx").alias("near_n")),
    ))
    links = near_pairs(words).select(both.alias("r")).select("r.*")
    # one shuffle: the words themselves and their links, partially aggregated
    rows = words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("bigint").alias("near_n")).unionByName(
        links.select("word", F.lit(None).cast("bigint").alias("n"), "near", "near_n")
    )
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("minus"), "near")))
    per_word = rows.groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    much = -F.col("best.minus") >= ratio * F.col("n")
    per_word = per_word.select(
        "word", "n", "n_near", F.when(much, F.col("best.near")).alias("form"), F.when(much, -F.col("best.minus")).alias("form_n"),
    ).checkpoint()
    roots = _roots(per_word.filter(F.col("form").isNotNull()))
    out = per_word.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, every: int = DAMAGE) -> DataFrame:
    """The spelling groups of a corpus: ``variants`` of its words that occur often enough."""
    words = word_counts(docs, id_col, text_col, least_length, every)
    return variants(words.filter(F.col("n") >= least_count), ratio)


def op13_spelling(spark, sf_dir):
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
