"""SimHash fingerprints and search by permuted block tables (DataFrame functions only).

Terms are pairs of adjacent words, weighted by how often they occur.  Each
term's 128 hash bits vote for or against the bits of the fingerprint.  The
votes of two bits share one 64-bit sum (32 bits each), so a text needs 64
sums; they are partial aggregates over the exploded terms.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockpilot.session import ensure_checkpoint_dir

BITS = 128
#: Texts whose five-word shingles have a similarity of 0.8 share 0.89 of their word pairs if the
#: edits touch (0.15 of the bits differ, 19 of 128) and 0.96 if they are apart (12 of 128).
RADIUS = 20
#: Prints of a key that meet a query in one row.
CHUNK = 256
WHITE = r"[\x20\x09-\x0D]+"
_TWO = (1 << 32) + 1


def _words(votes: str, count: str, first: int) -> Column:
    """64 fingerprint bits from 32 sums: a bit is set by more than half the weight."""
    return F.expr(
        f"aggregate(sequence(0, 31), 0L, (x, i) -> x"
        f" | if(2 * ({votes}[i + {first}] & 4294967295L) > {count}, shiftleft(1L, i), 0L)"
        f" | if(2 * shiftrightunsigned({votes}[i + {first}], 32) > {count}, shiftleft(1L, i + 32), 0L))"
    )


def fingerprints(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """keys, f0, f1 (the 128 bits as two longs), one row per distinct key.

    Rows of one key must hold one text.  A text of one word has that word as
    its only term; null, empty and blank texts have no term and the fingerprint 0."""
    words = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), WHITE), lambda w: w != "")
    rows = texts.select(*keys, words.alias("w")).select(
        *keys, F.explode_outer(F.arrays_zip("w", F.expr("slice(w, 2, size(w))").alias("v"))).alias("t")
    )
    rows = rows.select(*keys, F.xxhash64("t.w", "t.v").alias("h0"), F.xxhash64(F.lit(1), "t.v", "t.w").alias("h1"), F.col("t").isNotNull().cast("int").alias("one"))
    sums = [
        F.sum(F.shiftrightunsigned(h, i).bitwiseAND(F.lit(_TWO)) * F.col("one")).alias(f"{h}_{i}")
        for h in ("h0", "h1")
        for i in range(32)
    ]
    votes = rows.groupBy(*keys).agg(F.sum("one").alias("n"), *sums)
    votes = votes.select(*keys, "n", F.array(*(f"{h}_{i}" for h in ("h0", "h1") for i in range(32))).alias("s"))
    return votes.select(*keys, _words("s", "n", 0).alias("f0"), _words("s", "n", 32).alias("f1"))


def distance(a0, a1, b0, b1) -> Column:
    """Hamming distance of two fingerprints."""
    a0, a1, b0, b1 = (F.col(c) if isinstance(c, str) else c for c in (a0, a1, b0, b1))
    return F.bit_count(a0.bitwiseXOR(b0)) + F.bit_count(a1.bitwiseXOR(b1))


def likeness(d: Column) -> Column:
    """Cosine of the term vectors as the distance estimates it, 0 to 1."""
    return F.greatest(F.lit(0.0), F.cos(d * F.lit(3.141592653589793 / BITS)))


def as_text(f0: str, f1: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(f0), 16, "0"), F.lpad(F.hex(f1), 16, "0")))


def _blocks(radius: int) -> list[tuple[int, int, int, int, int]]:
    """Per table: first bit and width in f0, the same in f1, and the differing bits allowed.

    The allowances plus one add up to radius + 1, so prints that pass them in no
    table differ in more than ``radius`` bits."""
    units = radius + 1
    n = max(min(units, 7), -(-units // 3))
    if radius < 1 or n > 64:
        raise ValueError("radius must be 1 to 191")
    cuts = [(64 * t // n, BITS * t // n - 64 * t // n) for t in range(n + 1)]
    return [(a, c - a, b, d - b, units // n - 1 + (t < units % n)) for t, ((a, b), (c, d)) in enumerate(zip(cuts, cuts[1:]))]


def _key(block, f0: str = "f0", f1: str = "f1") -> Column:
    """The block's bits: the leading bits of its table's permutation."""
    a, m, b, n, _ = block
    low = F.shiftrightunsigned(F.col(f0), a).bitwiseAND(F.lit((1 << m) - 1))
    return low.bitwiseOR(F.shiftleft(F.shiftrightunsigned(F.col(f1), b).bitwiseAND(F.lit((1 << n) - 1)), m))


def _signed(x: int) -> int:
    return x - 2**64 if x >> 63 else x


def block_tables(prints: DataFrame, radius: int = RADIUS, probe: bool = False) -> DataFrame:
    """The rows once per table: t, key (the block that the table's permutation
    moves to the front).  With ``probe`` once for each key that differs in no
    more bits than the table allows: prints within the radius meet in at least
    one table if one side probes."""
    keys = []
    for t, block in enumerate(_blocks(radius)):
        width, flips = block[1] + block[3], block[4] if probe else 0
        masks = [sum(1 << i for i in some) for k in range(flips + 1) for some in itertools.combinations(range(width), k)]
        masks = F.array(*(F.lit(_signed(m)).cast("long") for m in masks))
        key, table = _key(block), F.lit(t)
        keys.append(F.transform(masks, lambda m: F.struct(table.alias("t"), key.bitwiseXOR(m).alias("key"))))  # noqa: B023
    return prints.select("*", F.explode(F.concat(*keys)).alias("e")).select(*prints.columns, "e.t", "e.key")


def _met_first(radius: int, t, a0, a1, b0, b1) -> Column:
    """Whether t is the first table in which the prints meet."""
    x, y = a0.bitwiseXOR(b0), a1.bitwiseXOR(b1)
    first = F
    for i, (a, m, b, n, flips) in enumerate(_blocks(radius)):
        bits = lambda word, at, wide: F.bit_count(word.bitwiseAND(F.lit(_signed(((1 << wide) - 1) << at))))
        first = first.when(bits(x, a, m) + bits(y, b, n) <= flips, i)
    return first == t


def find_within(queries: DataFrame, corpus: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All pairs of a query print (f0, f1) and a corpus print (g0, g1) with at
    most ``radius`` different bits, with ``bits``.  Both inputs are reduced to
    distinct prints first, so copies meet once; every pair is found once, in
    the first table where its blocks meet."""
    q = block_tables(queries.select("f0", "f1").distinct(), radius, probe=True).hint("merge")
    c = block_tables(corpus.select("f0", "f1").distinct(), radius)
    c = c.select(F.col("f0").alias("g0"), F.col("f1").alias("g1"), "t", "key")
    pairs = q.join(c, ["t", "key"]).withColumn("bits", distance("f0", "f1", "g0", "g1")).filter(F.col("bits") <= radius)
    first = _met_first(radius, F.col("t"), *map(F.col, ("f0", "f1", "g0", "g1")))
    return pairs.filter(first).select("f0", "f1", "g0", "g1", "bits")


def count_within(queries: DataFrame, corpus: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """f0, f1, near: per distinct query print the rows of ``corpus`` (f0, f1) with
    at most ``radius`` different bits; prints with none have no row.  The prints
    of a key meet a query in chunks of about ``chunk``, each counted in one row,
    so that a large group of near copies makes no row per pair."""
    sizes = corpus.groupBy("f0", "f1").agg(F.count("*").alias("n"))
    c = block_tables(sizes, radius)
    full = c.groupBy("t", "key").agg(F.ceil(F.count("*") / chunk).alias("parts")).filter("parts > 1")
    part = F.pmod(F.xxhash64("f0", "f1"), F.coalesce("parts", F.lit(1)))
    c = c.join(full, ["t", "key"], "left").withColumn("part", part)
    c = c.groupBy("t", "key", "part").agg(F.collect_list(F.struct(F.col("f0").alias("g0"), F.col("f1").alias("g1"), "n")).alias("members"))
    # the planner's estimate of the keys leaves out the explosion: they must never be broadcast
    q = block_tables(queries.select("f0", "f1").distinct(), radius, probe=True).hint("merge")

    def add(total, m):
        g = m["g0"], m["g1"]
        near = distance("f0", "f1", *g) <= radius
        return total + F.when(near & _met_first(radius, F.col("t"), F.col("f0"), F.col("f1"), *g), m["n"]).otherwise(0)

    found = q.join(c, ["t", "key"]).select("f0", "f1", F.aggregate("members", F.lit(0).cast("long"), add).alias("n"))
    return found.filter("n > 0").groupBy("f0", "f1").agg(F.sum("n").alias("near"))


KEY = ["i", "z", "th"]  # doc_id (0 if null), whether it is null, text hash: never null


def _successors(docs: DataFrame) -> DataFrame:
    """Distinct keys with n_chars, copies and the key of the next one in
    descending doc_id (null ids last, then by text hash); after the last: the first."""
    narrow = docs.groupBy(*KEY, "n_chars").agg(F.count("*").alias("copies"))
    ordered = narrow.orderBy("z", F.desc("i"), "th")
    ordered = ordered.withColumn("at", F.monotonically_increasing_id()).checkpoint()
    part = F.expr("at >> 33")
    counts = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    total = ordered.count()
    # one row per partition of the sort: its size is bounded by spark.sql.shuffle.partitions
    offsets = counts.selectExpr("part", "coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0) as first")
    ranked = ordered.withColumn("part", part).join(F.broadcast(offsets), "part")
    ranked = ranked.withColumn("rank", F.expr("first + at % 8589934592")).drop("part", "first", "at")
    after = ranked.select(
        F.expr(f"(rank - 1 + {max(total, 1)}) % {max(total, 1)}").alias("rank"),
        *(F.col(c).alias(f"next_{c}") for c in KEY),
    )
    return ranked.join(after, "rank").drop("rank")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, f0, f1 (own), e0, e1 (edited), x0, x1 (the
    next document's): one row per input row.

    The edited text has the last floor(n_chars / 3) code points replaced by the
    first as many (or all) of the next document in descending doc_id.  Null
    text is empty text.  Rows equal in doc_id and text are one document in that
    order and give equal rows; null ids come last; a document alone is its own
    next.  An empty table gives no rows; other columns are ignored."""
    ensure_checkpoint_dir(docs.sparkSession)
    base = docs.select(
        F.coalesce(F.col(id_col), F.lit(0)).alias("i"),
        F.col(id_col).isNull().alias("z"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumn("th", F.xxhash64("text"))
    order = _successors(base.select(*KEY, F.length("text").alias("n_chars"))).checkpoint()

    # the next document lends its head; both joins find the texts by the same shuffle
    ask = order.select(*(F.col(f"next_{c}").alias(c) for c in KEY), *(F.col(c).alias(f"for_{c}") for c in KEY), F.expr("n_chars div 3").cast("int").alias("k"))
    lent = base.join(ask, KEY).select(*(F.col(f"for_{c}").alias(c) for c in KEY), "k", F.expr("substring(text, 1, k)").alias("head"))
    edited = F.expr("concat(substring(text, 1, length(text) - k), head)")
    both = base.join(lent, KEY).select(*KEY, "text", edited.alias("edited")).dropDuplicates(KEY)

    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("x")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("x")))
    each = both.select(*KEY, F.explode(kinds).alias("e")).select(*KEY, "e.kind", "e.x")
    each = each.withColumn("sha", F.when(F.col("kind") == 1, F.sha2("x", 256)))
    prints = fingerprints(each, [*KEY, "kind", "sha"], "x")
    pick = lambda c, kind: F.max(F.when(F.col("kind") == kind, F.col(c)))
    prints = prints.groupBy(*KEY).agg(
        F.max("sha").alias("edited_sha256"),
        *(pick(c, kind).alias(n) for c, kind, n in (("f0", 0, "f0"), ("f1", 0, "f1"), ("f0", 1, "e0"), ("f1", 1, "e1"))),
    )
    prints = prints.checkpoint()

    after = prints.select(*(F.col(c).alias(f"next_{c}") for c in KEY), F.col("f0").alias("x0"), F.col("f1").alias("x1"))
    out = order.join(prints, KEY).join(after, [f"next_{c}" for c in KEY])
    cols = ("n_chars", "edited_sha256", "f0", "f1", "e0", "e1", "x0", "x1")
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    return out.select(F.when(~F.col("z"), F.col("i")).alias("doc_id"), *cols, copies).drop("copy")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    """Besides the asked columns: ``within_radius``, the number of other
    documents whose fingerprint differs in at most RADIUS bits, for the queries
    doc_id % 20 = 0 (null for other rows)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    prints = edited_fingerprints(docs).checkpoint()
    asked = F.col("doc_id") % 20 == 0
    near = count_within(prints.filter(asked), prints).checkpoint()  # stored, so that the join may split hot fingerprints
    out = prints.join(near, ["f0", "f1"], "left")
    return out.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        "edited_sha256",
        as_text("f0", "f1").alias("fingerprint"),
        as_text("e0", "e1").alias("edited_fingerprint"),
        likeness(distance("f0", "f1", "e0", "e1")).alias("near_edited"),
        likeness(distance("f0", "f1", "x0", "x1")).alias("near_next"),
        F.when(asked, F.col("near") - 1).alias("within_radius"),
    )
