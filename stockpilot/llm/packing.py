"""Packing of tokenised documents into sequences of fixed length.

Bounded-space online best fit: every partition keeps a fixed number of open
windows.  A document (what is left of it after its full windows) goes whole to
the open window with the smallest gap that takes it; when none fits, the
fullest window is topped up with the document's head and emitted.  The windows
still open at a partition's end are merged over groups of partitions, round by
round, so that the whole corpus ends with at most one sequence that is not full.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import struct
import zlib
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockpilot.llm.columns import BATCH_CHARS
from stockpilot.llm.deploy import prepare_workers
from stockpilot.session import scratch_path

LENGTH = 2048
END_ID = 1
OPEN_WINDOWS = 32
#: Partitions whose open windows one merging task takes.
FAN_IN = 32
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long, ids binary"


class TextIds:
    """Ids of texts, as little-endian uint32 bytes, as the tokenizers library
    gives them from a byte-level BPE file.

    The file's vocabulary is read into tiktoken, whose ids are equal (tests
    compare them) at a third of the CPU time.  It needs tokens numbered in the
    order of their merges; other files, and texts longer than BATCH_CHARS, which
    are taken in steps of bounded size, go through tokenizers itself.

    The text of a special token (``<|endoftext|>``) gives that token's id, as in
    the library; with ``special`` off it is ordinary text."""

    def __init__(self, path: str | None, special: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import public_tokenizers
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        path = path or public_tokenizers.path("byte_bpe_50k.json")
        self.find = regex.compile(public_tokenizers.PATTERN).finditer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            stored = json.load(f)
        model = stored["model"]
        names = {t["content"]: t["id"] for t in stored.get("added_tokens") or () if special and t.get("special")}
        self.special = {name: struct.pack("<I", i) for name, i in names.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(names, key=len, reverse=True))) + ")") if names else None
        merged = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        order = [model["vocab"]["".join(m)] for m in merged]
        self.fast = None
        if order == sorted(order):
            back = byte_letters()
            ranks = {bytes(map(back.__getitem__, t)): i for t, i in model["vocab"].items() if all(c in back for c in t)}
            made = set(order)
            ranks = {t: i for t, i in ranks.items() if len(t) == 1 or i in made}  # no special tokens
            self.fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if any(name in text for name in self.special):
            return b"".join([self.special.get(part) or self.ordinary(part) for part in self.split.split(text)])
        return self.ordinary(text)

    def ordinary(self, text: str) -> bytes:
        """Ids of a text in which no special token is looked for."""
        if self.fast is not None and len(text) <= BATCH_CHARS:
            ids = self.fast.encode_ordinary(text)
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(self.in_steps(text))

    def in_steps(self, text: str):
        """The pattern's matches are encoded each on its own, some at a time."""
        matches = (m[0] for m in self.find(text))
        while some := list(itertools.islice(matches, 1 << 15)):
            words = list(dict.fromkeys(some))
            found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
            known = {w: struct.pack(f"<{len(e.ids)}I", *e.ids) for w, e in zip(words, found)}
            yield b"".join([known[w] for w in some])


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabulary files write bytes: printable
    Latin-1 characters stand for themselves, the other bytes for the code
    points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=1)
def text_ids(path: str | None, special: bool = True) -> TextIds:
    return TextIds(path, special)


class Rows:
    """Piece rows on their way to Arrow batches."""

    kinds = (*[pa.int64()] * 8, pa.binary())
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def __init__(self, keep_ids: bool):
        self.rows: list[tuple] = []
        self.keep_ids = keep_ids

    def add(self, piece, sequence, offset, part):
        doc, start, ids, tokens = piece
        kept = ids if self.keep_ids or sequence is None else None
        self.rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), tokens, sequence, offset, part, kept))

    def sequence(self, pieces, number, part):
        offset = 0
        for p in pieces:
            self.add(p, number, offset, part)
            offset += len(p[2]) // 4

    def batch(self):
        cols = list(zip(*self.rows)) if self.rows else [()] * 9
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, self.kinds)], self.names)


def cut(piece, n):
    """The first n ids of a piece, and the rest."""
    doc, start, ids, tokens = piece
    return (doc, start, ids[: 4 * n], tokens), (doc, start + n, ids[4 * n :], tokens)


def sequence_number(round_: int, part: int, count: int) -> int:
    return round_ << 57 | part << 27 | count


class Windows:
    """The open windows of a partition, by gap."""

    def __init__(self, length: int, limit: int):
        self.length, self.limit = length, limit
        self.gaps: list[tuple[int, int]] = []
        self.pieces: dict[int, list] = {}
        self.made = 0

    def place(self, piece):
        """Yields the sequences that become full."""
        while (n := len(piece[2]) // 4) >= self.length:
            head, piece = cut(piece, self.length)
            yield [head]
        while n:
            i = bisect_left(self.gaps, (n, -1))
            if i < len(self.gaps):  # the smallest gap that takes it whole
                gap, w = self.gaps.pop(i)
            elif len(self.gaps) < self.limit:
                gap, w, self.made = self.length, self.made, self.made + 1
                self.pieces[w] = []
            else:  # none fits: top up the fullest
                gap, w = self.gaps.pop(0)
            head, piece = cut(piece, min(n, gap))
            took = len(head[2]) // 4
            self.pieces[w].append(head)
            if took == gap:
                yield self.pieces.pop(w)
            else:
                insort(self.gaps, (gap - took, w))
            n -= took


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    end_id: int = END_ID,
    open_windows: int = OPEN_WINDOWS,
    vocabulary: str | None = None,
    keep_ids: bool = True,
    fan_in: int = FAN_IN,
    special_tokens: bool = True,
) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    ids (little-endian uint32; null unless keep_ids).  The text of a special
    token gives its id, unless ``special_tokens`` is off.

    Every row of ``docs`` is a document of its own, repeated rows and rows
    without doc_id too; a null or empty text has the end id only.  Each id lies
    in exactly one piece; offsets in a sequence have no gap; all sequences but
    one are full.  An empty table gives no pieces; other columns are ignored."""
    spark = docs.sparkSession
    prepare_workers(spark)
    end = end_id.to_bytes(4, "little")

    def first(batches):
        encode, windows, out = text_ids(vocabulary, special_tokens), Windows(length, open_windows), Rows(keep_ids)
        part, count = TaskContext.get().partitionId(), 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + end
                for full in windows.place((doc, 0, ids, len(ids) // 4)):
                    out.sequence(full, sequence_number(0, part, count), part)
                    count += 1
                if len(out.rows) >= 2048:
                    yield out.batch()
        for pieces in windows.pieces.values():
            for p in pieces:
                out.add(p, None, None, part)
        yield out.batch()

    def merge(round_, last):
        def run(batches):
            out, held, size, group, count = Rows(keep_ids), [], 0, None, 0

            def close():
                for p in held if not last else ():
                    out.add(p, None, None, group)
                if last and held:
                    out.sequence(held, sequence_number(round_, group, count), group)

            for batch in batches:
                for doc, start, tokens, part, ids in zip(*(batch.column(i).to_pylist() for i in range(5))):
                    if part // fan_in != group:
                        close()
                        held, size, group, count = [], 0, part // fan_in, 0
                    piece = (doc, start, ids, tokens)
                    while len(piece[2]):
                        head, piece = cut(piece, min(len(piece[2]) // 4, length - size))
                        held.append(head)
                        size += len(head[2]) // 4
                        if size == length:
                            out.sequence(held, sequence_number(round_, group, count), group)
                            held, size, count = [], 0, count + 1
                if len(out.rows) >= 2048:
                    yield out.batch()
            close()
            yield out.batch()

        return run

    def stored(df):
        path = scratch_path(spark, "packed")
        df.write.parquet(path)
        return spark.read.schema(SCHEMA).parquet(path)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    done = stored(rows.mapInArrow(first, SCHEMA))
    parts, round_ = [done.filter("sequence_id is not null")], 0
    while (top := done.filter("sequence_id is null").agg(F.max("part")).first()[0]) is not None:
        round_ += 1
        rest = done.filter("sequence_id is null").withColumn("group", F.expr(f"part div {fan_in}"))
        rest = rest.repartition("group").sortWithinPartitions("group", "part", "doc_id", "start", "ids_crc32")
        rest = rest.select("doc_id", "start", "doc_tokens", "part", "ids")
        done = stored(rest.mapInArrow(merge(round_, top < fan_in), SCHEMA))
        parts.append(done.filter("sequence_id is not null"))
    out = functools.reduce(DataFrame.unionByName, parts)
    return out.drop("part")


def op1_pack(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_ids=False).drop("ids")
