"""Byte-level BPE encoding and decoding in linear time.

The bytes of a match are read as Latin-1, so that an Aho-Corasick automaton
(pyahocorasick) finds the longest token at every position in one pass.  The
encoder takes the longest token, steps back to shorter ones where two adjacent
tokens are not what the merges would leave side by side, and never tries an
end position twice; whether two tokens may be adjacent is remembered.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockpilot.llm.deploy import prepare_workers

#: Distinct matches and token pairs that a worker remembers.
REMEMBERED = 300_000


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.rank = {b.decode("latin-1"): r for b, r in ranks.items()}
        self.text = {r: s for s, r in self.rank.items()}
        self.size = {r: len(s) for s, r in self.rank.items()}
        self.bytes_of = {str(r): b for b, r in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for s, r in self.rank.items():
            self.automaton.add_word(s, (r, len(s)))
        self.automaton.make_automaton()
        self.shorter: dict[int, int | None] = {}
        for s, r in self.rank.items():  # the longest token that is a proper prefix
            self.shorter[r] = next((self.rank[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in self.rank), None)
        self.adjacent: dict[tuple[int, int], bool] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for s, r in sorted(self.rank.items(), key=lambda x: x[1]):
            self.halves[r] = self._last_merge(s, r)
        self.adjacent.clear()
        self.matcher = regex.compile(pattern)
        self.known: dict[str, str] = {}

    def _last_merge(self, s: str, r: int) -> tuple[int, int]:
        """The two tokens whose merge is r; (r, r) for a single byte."""
        left = self.shorter[r]
        while left is not None:
            right = self.rank.get(s[self.size[left] :])
            if right is not None and left < r and right < r and self._may_touch(left, right):
                self.merged[left, right] = r
                return left, right
            left = self.shorter[left]
        return r, r

    def _may_touch(self, a: int, b: int) -> bool:
        """Whether the merges leave a and b side by side: undoing the merges of
        both from the latest on, no pair across the border merges earlier."""
        key = (a, b)
        if (known := self.adjacent.get(key)) is not None:
            return known
        below, fine = 1 << 32, None
        while fine is None:
            if self.merged.get((a, b), below) < below:
                fine = False
            elif a > b:
                below, a = a, self.halves[a][1]
                if a == below:  # a single byte: go on with b
                    below, b = b + 1, self.halves[b][0]
                    if b + 1 == below:
                        fine = True
            else:
                below, b = b + 1, self.halves[b][0]
                if b + 1 == below:
                    below, a = a, self.halves[a][1]
                    if a == below:
                        fine = True
        if len(self.adjacent) >= REMEMBERED:
            self.adjacent.clear()
        self.adjacent[key] = fine
        return fine

    def encode_match(self, match: str) -> list[int]:
        s = match.encode("utf-8", "surrogatepass").decode("latin-1")
        if s in self.rank:
            return [self.rank[s]]
        longest = [0] * len(s)
        for end, (token, n) in self.automaton.iter(s):
            longest[end - n + 1] = token  # a later end is a longer token
        alive = bytearray(b"\1" * (len(s) + 1))
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + self.size[token]
            if alive[end] and (not out or self._may_touch(out[-1], token)):
                out.append(token)
                at = end
                if at == len(s):
                    return out
                token = longest[at]
            elif (token := self.shorter[token]) is None:
                alive[at] = 0
                token = out.pop()
                at -= self.size[token]

    def _ids(self, matches: list[str]) -> str:
        known = self.known
        try:
            return " ".join([known[m] for m in matches])
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            for m in matches:
                if m not in known:
                    known[m] = " ".join(map(str, self.encode_match(m)))
            return " ".join([known[m] for m in matches])

    def encode(self, text: str):
        """The ids as decimal text joined by spaces, in one or more parts."""
        if len(text) <= 1 << 20:
            if text:
                yield self._ids(self.matcher.findall(text))
            return
        some: list[str] = []
        for m in self.matcher.finditer(text):
            some.append(m[0])
            if len(some) == 1 << 16:
                yield self._ids(some)
                some = []
        if some:
            yield self._ids(some)

    def decode(self, ids: str) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids.split(" ")])


@functools.lru_cache(maxsize=1)
def load(path: str | None = None) -> ByteBPE:
    import public_tokenizers

    lines = open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read().split(b"\n")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, lines))}
    return ByteBPE(ranks, public_tokenizers.PATTERN)


def _encoded(batches, path):
    coder = load(path)
    for batch in batches:
        rows = []
        for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows.append((key, " ".join(coder.encode(value.as_py() or ""))))
        keys, ids = zip(*rows) if rows else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.large_string())], ["doc_id", "ids"])


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids (decimal, joined by one space): one row per input row, null
    ids and repeated rows included; null and empty texts have no ids."""
    prepare_workers(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda batches: _encoded(batches, vocabulary), "doc_id long, ids string")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, bytes from doc_id, ids; null and empty ids give no bytes."""
    prepare_workers(encoded.sparkSession)

    def run(batches):
        coder = load(vocabulary)
        for batch in batches:
            out = [coder.decode(x) if x else b"" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.large_binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes each text, decodes
    the ids and keeps digests only.  Row by row; nulls count as empty texts."""
    prepare_workers(docs.sparkSession)

    def run(batches):
        coder = load(vocabulary)
        for batch in batches:
            out = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                n, ids, plain = 0, hashlib.sha256(), hashlib.sha256()
                for part in coder.encode(value.as_py() or ""):
                    ids.update((" " * (n > 0) + part).encode())
                    n += part.count(" ") + 1
                    plain.update(coder.decode(part))
                out.append((key, n, ids.hexdigest(), plain.hexdigest()))
            cols = zip(*out) if out else ((),) * 4
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
