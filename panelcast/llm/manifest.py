"""A Merkle manifest of a table: leaves per group in the order of their ids, with proofs.

A leaf's place in its group is a rank in the bitmap of the group's ids. Bitmaps are merged from bit
masks of 64 ids (only words that hold an id exist) and carry a directory of counts, so no group is
sorted or gathered. Ranks then say in which slot of which run a node stands, and a level is one
aggregation of slots by run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.common import stored
from panelcast.operators.position import with_position

#: Children of a node.
FAN = 16
#: Entries of one level of a directory are summed in runs of 2^10 keys.
RUN_BITS = 10
#: A directory whose longest group has no more entries is summed in one go.
TOP_ENTRIES = 1 << 12
#: Stands for the word of a null id: before every word of a real one.
_NULL_WORD = -(1 << 58)


def hashed(text: Column) -> Column:
    """Lowercase hex sha256 of a string's UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def encoded(column: Column) -> Column:
    """A value as ``-`` if null, else its number of UTF-8 bytes, a colon and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: Sequence[Column]) -> Column:
    return hashed(F.concat(*[encoded(c) for c in fields]))


def _popcount(bits: Column) -> Column:
    return F.bit_count(bits).cast("long")


def directory(counts: DataFrame, name: str = "directory") -> DataFrame:
    """(g, key, n) -> (g, key, start): the sum of n over the smaller keys of the same g.

    Runs of 2^RUN_BITS keys are summed on their own; the sums of whole runs come from a directory
    one level up, until no group has more than TOP_ENTRIES of them.
    """
    longest = counts.groupBy("g").count().agg(F.max("count")).first()[0] or 0
    if longest <= TOP_ENTRIES:
        before = Window.partitionBy("g").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
        start = F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))
        return counts.select("g", "key", start.alias("start"))
    run = F.shiftright("key", RUN_BITS)
    upper = counts.groupBy("g", run.alias("key")).agg(F.sum("n").alias("n"))
    above = directory(stored(upper, name), name)
    above = above.select("g", F.col("key").alias("run"), F.col("start").alias("above"))
    before = Window.partitionBy("g", "run").orderBy("key")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))
    found = counts.withColumn("run", run).withColumn("inside", inside)
    return found.join(above, ["g", "run"]).select(
        "g", "key", (F.col("above") + F.col("inside")).alias("start")
    )


def coordinates(leaves: DataFrame) -> DataFrame:
    """Adds ``pos``: the 0-based place of a row (g, id, row, leaf, ...) in its group by id.

    Null ids come first. Rows that repeat an id stand in the order of their leaves; of equal leaves
    either may come first, which changes no digest.
    """
    word = F.coalesce(F.shiftright("id", 6), F.lit(_NULL_WORD)).alias("key")
    bit = F.coalesce(F.col("id").bitwiseAND(F.lit(63)), F.lit(0)).cast("int").alias("bit")
    placed = leaves.select("*", word, bit)
    words = placed.groupBy("g", "key").agg(
        F.expr("bit_or(shiftleft(1L, bit))").alias("bits"), F.count("*").alias("n")
    )
    words = stored(words, "bitmaps")
    starts = words.join(directory(words.select("g", "key", "n")), ["g", "key"])
    # Words with more rows than ids hold repeated ids (or null ones): their ranks are counted out.
    several = F.col("n") > _popcount(F.col("bits"))
    starts = starts.select("g", "key", "bits", "start", several.alias("repeated"))
    below = F.expr("bits & ~shiftleft(-1L, bit)")
    ranked = placed.join(starts, ["g", "key"])
    plain = ranked.where(~F.col("repeated")).withColumn("pos", F.col("start") + _popcount(below))
    plain = plain.select(*leaves.columns, "pos")
    repeated = words.where(several).select("g", "key")
    if not repeated.limit(1).count():
        return plain
    again = placed.join(repeated, ["g", "key"], "left_semi").select("g", "key", "bit", "leaf", "row")
    again = with_position(again, ["g", "key", "bit", "leaf", "row"], "at")
    first = again.groupBy("g", "key").agg(F.min("at").alias("first"))
    offset = (F.col("at") - F.col("first")).alias("offset")
    offsets = stored(again.join(first, ["g", "key"]).select("row", offset), "repeated-ids")
    rest = ranked.where("repeated").join(offsets, "row")
    rest = rest.withColumn("pos", F.col("start") + F.col("offset"))
    return plain.unionByName(rest.select(plain.columns))


def _runs(nodes: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """Nodes (g, pos, digest) -> runs (g, pos, slots, alone, digest): slots hold the digests (and
    the carried columns) of up to FAN consecutive nodes by their slot number. A single node at the
    head of its group is the top of its tree: it stays as it is."""
    slot = F.pmod("pos", F.lit(FAN)).cast("int")
    item = F.struct("digest", *carried)
    runs = nodes.groupBy("g", F.expr(f"pos div {FAN}").alias("pos")).agg(
        F.map_from_entries(F.collect_list(F.struct(slot, item))).alias("keyed")
    )
    runs = runs.select(
        "g",
        "pos",
        F.expr("transform(sequence(0, size(keyed) - 1), i -> keyed[i])").alias("slots"),
    ).withColumn("alone", (F.col("pos") == 0) & (F.size("slots") == 1))
    joined = F.array_join(F.transform("slots", lambda s: s["digest"]), "")
    top = F.col("slots")[0]["digest"]
    return runs.withColumn("digest", F.when(F.col("alone"), top).otherwise(hashed(joined)))


def _levels(runs: DataFrame, name: str) -> list[DataFrame]:
    """All levels of the trees, from the runs of leaves up to one run for each group."""
    levels = [runs]
    while levels[-1].where("pos > 0").limit(1).count():
        nodes = levels[-1].select("g", "pos", "digest")
        levels.append(stored(_runs(nodes), f"{name}-{len(levels)}"))
    return levels


def _children(runs: DataFrame) -> DataFrame:
    """One row for each node of the runs, with the step from it to its parent put before the
    ``path`` that the run has: siblings left and right of it, and whether they are hashed."""
    digests = F.transform("slots", lambda s: s["digest"])
    found = runs.select("*", F.posexplode("slots").alias("slot", "child"))
    step = F.struct(
        F.array_join(F.slice(digests, F.lit(1), F.col("slot")), "").alias("left"),
        F.array_join(F.slice(digests, F.col("slot") + 2, F.lit(FAN)), "").alias("right"),
        (~F.col("alone")).alias("hashed"),
    )
    return found.withColumn("path", F.concat(F.array(step), "path")).withColumn(
        "pos", F.col("pos") * FAN + F.col("slot")
    )


def _paths(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The runs of leaves with the path from each run to the root; ``tops`` (g, path, ...) has the
    paths from the groups' highest nodes."""
    carried = [c for c in tops.columns if c not in ("g", "path")]
    paths = levels[-1].join(tops, "g")
    for below in reversed(levels[:-1]):
        nodes = _children(paths).select("g", "pos", "path", *carried)
        paths = below.join(nodes, ["g", "pos"])
    return paths


def _folded(leaf: Column, path: Column) -> Column:
    def up(acc: Column, step: Column) -> Column:
        return F.when(step["hashed"], hashed(F.concat(step["left"], acc, step["right"]))).otherwise(acc)

    return F.aggregate(path, leaf, up)


_STEP = "array<struct<left: string, right: string, hashed: boolean>>"


def manifest(
    docs: DataFrame,
    fields: Sequence[str],
    id_col: str = "doc_id",
    group_col: str = "source",
    tampered: Sequence[Column] | None = None,
    when_tampered: Column | None = None,
) -> DataFrame:
    """One row for each row of ``docs``: id, leaf, subroot of its group, root, the digest of its
    proof, and the root folded from its leaf and its siblings (``verified``: equal to the root).

    ``fields`` are the columns that a leaf covers, in order. Where ``when_tampered`` holds, folding
    starts from the leaf over ``tampered`` instead. Groups are ordered null first, then by UTF-8
    bytes; an empty string is a group of its own. Rows of a null id come first in their group, rows
    that repeat an id are ordered by their leaf; rows that are equal throughout have equal leaves
    at different places. Empty tables give no rows. Other columns of ``docs`` are not read.
    """
    leaf = leaf_digest([F.col(c) for c in fields])
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    other = F.lit(None).cast("string")
    if tampered is not None:
        other = F.when(when_tampered, leaf_digest(tampered))
    kind = dict(docs.dtypes)[id_col]
    leaves = stored(
        docs.select(
            group.alias("g"),
            F.col(id_col).cast("long").alias("id"),
            F.monotonically_increasing_id().alias("row"),
            leaf.alias("leaf"),
            other.alias("other"),
        ),
        "leaves",
    )
    nodes = coordinates(leaves).withColumnRenamed("leaf", "digest")
    levels = _levels(stored(_runs(nodes, ["id", "other"]), "runs-0"), "runs")
    # The trees of the groups have one run left each: their digests are the leaves of the top tree.
    subroots = stored(levels[-1].select(F.col("g").alias("group"), "digest"), "subroots")
    tops = with_position(subroots, ["group"], "pos").withColumn("g", F.lit(""))
    upper = _levels(stored(_runs(tops, ["group"]), "top-0"), "top")
    root = upper[-1].select("g", F.col("digest").alias("root"), F.array().cast(_STEP).alias("path"))
    paths = _children(_paths(upper, root)).select(
        F.col("child.group").alias("g"), F.col("child.digest").alias("subroot"), "root", "path"
    )
    found = _children(_paths(levels, stored(paths, "group-paths")))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    start = F.coalesce("child.other", "child.digest")
    return found.select(
        F.col("child.id").cast(kind).alias(id_col),
        F.col("child.digest").alias("leaf"),
        "subroot",
        "root",
        hashed(siblings).alias("proof_sha256"),
        _folded(start, F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
