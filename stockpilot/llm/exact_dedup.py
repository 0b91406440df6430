"""Exact dedup by deterministic block naming (DataFrame functions only).

A normalised text is cut into fixed-size byte blocks.  The distinct blocks are
sorted and numbered; then adjacent numbers are paired and the distinct pairs
sorted and numbered again, level by level, until each document is left with
one number.  Two texts get the same (level, number) exactly when they are
equal, so the identity is free of collisions.

Blocks are sorted by (64-bit hash, bytes).  A hash that belongs to one block
only stands for that block, so the block bytes are shuffled once, to establish
which hashes those are; blocks that share a hash are told apart by their bytes.
The document rows carry integers only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockpilot.llm.columns import positional
from stockpilot.session import ensure_checkpoint_dir

BLOCK_BYTES = 4096
WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Null counts as empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def _blocks(docs: DataFrame, id_col: str, text_col: str, size: int, hash_of) -> DataFrame:
    """One row per block: doc_id, tag (SHA-256 of the normalised text, which
    tells apart rows that share a doc_id), blocks, pos, block, h."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.encode(normalised(F.col(text_col)), "UTF-8").alias("bytes"))
    cut = F.expr(
        f"transform(sequence(0, greatest(0, (octet_length(bytes) - 1) div {size})),"
        f" i -> substring(bytes, cast(i * {size} + 1 as int), {size}))"
    )
    rows = base.select("doc_id", F.unhex(F.sha2("bytes", 256)).alias("tag"), cut.alias("cut"))
    # outer: there is always a block, and no filter on the blocks' number is derived and pushed to the scan
    rows = rows.select("doc_id", "tag", F.size("cut").alias("blocks"), F.posexplode_outer("cut").alias("pos", "block"))
    return rows.withColumn("h", hash_of(F.col("block")))


def _numbered(keys: DataFrame, *cols: str) -> DataFrame:
    """Distinct keys in global sort order, each with an integer name that
    follows the order.  Names are unique; the caller fixes them by a checkpoint."""
    return keys.orderBy(*cols).withColumn("name", F.monotonically_increasing_id())


def _first_names(docs: DataFrame, id_col: str, text_col: str, size: int, hash_of) -> DataFrame:
    rows = _blocks(docs, id_col, text_col, size, hash_of)
    per_hash = rows.select("h", "block").distinct().groupBy("h").agg(F.count("*").alias("n")).checkpoint()
    occ = rows.select("doc_id", "tag", "blocks", "pos", "h")
    shared = per_hash.filter("n > 1").select("h")
    if shared.isEmpty():
        return occ.join(_numbered(per_hash.select("h"), "h"), "h").drop("h").checkpoint()
    # blocks that share a hash: the rank of their bytes tells them apart
    among = rows.join(shared, "h").select("h", "block").distinct()
    ranked = among.withColumn("k", F.row_number().over(Window.partitionBy("h").orderBy("block"))).checkpoint()
    alone = per_hash.filter("n = 1").select("h", F.lit(0).alias("k"))
    names = _numbered(alone.unionByName(ranked.select("h", "k")), "h", "k")
    told = rows.join(ranked, ["h", "block"]).select(*occ.columns, "k")
    rest = occ.join(shared, "h", "left_anti").select(*occ.columns, F.lit(0).alias("k"))
    return rest.unionByName(told).join(names, ["h", "k"]).drop("h", "k").checkpoint()


def identities(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, hash_of=F.xxhash64
) -> DataFrame:
    """One row per document: doc_id, tag, level, name.  (level, name) is equal
    for two rows exactly when their normalised texts are equal."""
    ensure_checkpoint_dir(docs.sparkSession)
    named = _first_names(docs, id_col, text_col, block_bytes, hash_of)
    most = named.agg(F.max("blocks")).first()[0] or 1
    done = named.filter("blocks = 1").select("doc_id", "tag", F.lit(0).alias("level"), "name")
    longer = named.filter("blocks > 1 and pos = 0").select("doc_id", "tag")
    live, ends = named.filter("blocks > 1"), []
    for level in range(1, math.ceil(math.log2(most)) + 1 if most > 1 else 1):
        side = F.col("pos") % 2
        pairs = live.groupBy("doc_id", "tag", F.expr("pos div 2").alias("pos")).agg(
            F.max(F.when(side == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(side == 1, F.col("name"))), F.lit(-1)).alias("b"),
            F.max(F.ceil(F.col("blocks") / 2)).alias("blocks"),
        )
        names = _numbered(pairs.select("a", "b").distinct(), "a", "b")
        step = pairs.join(names, ["a", "b"]).select("doc_id", "tag", "blocks", "pos", "name").checkpoint()
        ends.append(step.filter("blocks = 1").select("doc_id", "tag", F.lit(level).alias("level"), "name"))
        live = step.filter("blocks > 1")
    if ends:
        found = ends[0]
        for e in ends[1:]:
            found = found.unionByName(e)
        same = longer["doc_id"].eqNullSafe(found["doc_id"]) & (longer["tag"] == found["tag"])
        done = done.unionByName(longer.join(found, same).select(longer["doc_id"], longer["tag"], "level", "name"))
    return done


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, hash_of=F.xxhash64
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per input row.

    Of equal normalised texts the smallest doc_id stays.  Null text is empty
    text; all empty texts are equal.  A row without doc_id counts in its group
    and stays only if no row of the group has one (keep_id is then null).
    Repeated rows each count and each give a row, all with the same answer.
    An empty table gives no rows; other columns are ignored."""
    # narrow rows, read twice: the groups' plan need not hold the levels' plans
    who = identities(docs, id_col, text_col, block_bytes, hash_of).checkpoint()
    groups = who.groupBy("level", "name").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = groups.checkpoint()  # stored, so that adaptive execution may split a hot group's rows in the join
    return who.join(groups, ["level", "name"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("tag")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows that stay, each once, with all their columns, whatever their names."""
    rows, (i, text) = positional(docs, id_col, text_col)
    kept = exact_dedup(rows, i, text).filter("kept").select("doc_id", "text_sha256").distinct().toDF("id", "sha")
    tagged = rows.withColumn("tag", F.sha2(F.encode(normalised(F.col(text)), "UTF-8"), 256))
    stay = tagged.join(kept, F.col(i).eqNullSafe(F.col("id")) & (F.col("tag") == F.col("sha"))).dropDuplicates(["id", "sha"])
    return stay.select(*rows.columns).toDF(*docs.columns)


ORACLE = r"""
with n as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents
), g as (
  select t, min(doc_id) as keep_id, count(*) as group_size from n group by t
)
select n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id as kept, sha256(n.t) as text_sha256
from n join g on n.t = g.t
"""
