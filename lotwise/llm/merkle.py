"""A Merkle manifest of a dataset: one tree of leaves per group, and one tree of the groups' roots.

Nodes of a tree are numbered from 0. A run is 16 consecutive nodes (the last run of a level: fewer, even one); its
digests in a row give the parent's digest, until one node remains. A tree of one leaf has that leaf as its root.

Per level, lag and lead columns at fixed offsets, masked by a node's slot and by the length of its run, are its
siblings, and the row of a run's first child hashes the parent. Two levels share one window over blocks of 16 * 16
nodes, in which the nodes of the second level stand 16 rows apart. The roots of blocks are the nodes of the next
round, 256 times fewer, so a group of any size is spread over blocks and no task holds more of it than some blocks. Numbers
come from a sort by ranges: each range has its rows counted, and begins where those before it end.

Rows that repeat in all columns have leaves of their own. NULLs are marked in leaves and come first in every order,
equal keys are ordered by their leaves. An empty table has an empty manifest. Other columns of the documents do not matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm.corpus import written

FAN = 16
BLOCK = FAN * FAN
# Rows that one range of the sort has at most, about, once the session's shuffle partitions are too few.
RANGE_ROWS = 1_000_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
# The one tree above all groups.
WHOLE = "whole"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts' bytes in a row."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for NULL, else the value's length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(columns: Sequence[str] = COLUMNS, change: dict[str, Column] | None = None) -> Column:
    """The leaf of a row; ``change`` puts other values in the place of columns."""
    return digest(*[field((change or {}).get(c, F.col(f"`{c}`"))) for c in columns])


def numbered(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """``nodes`` plus ``at``, their number in their ``tree`` by ``order``, and ``n``, the nodes of the tree."""
    ranges = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-nodes.count() // RANGE_ROWS))
    marked = written(nodes.withColumn("tie", F.monotonically_increasing_id()), "merkle-nodes")
    keys = ["tree", *order, "tie"]
    cut = written(marked.repartitionByRange(ranges, *keys).withColumn("range", F.spark_partition_id()), "merkle-ranges")
    held = cut.groupBy("tree", "range").agg(F.count(F.lit(1)).alias("rows"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    begins = held.select(
        "tree", "range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"), F.sum("rows").over(tree).alias("n")
    )
    inside = Window.partitionBy("tree", "range").orderBy(*order, "tie")
    placed = cut.withColumn("number", F.row_number().over(inside)).join(begins, ["tree", "range"])
    return placed.withColumn("at", F.col("first") + F.col("number") - 1).drop("tie", "range", "first", "number")


def with_sides(nodes: DataFrame) -> DataFrame:
    """Two levels above each node: ``sides``, its siblings left and right at each of them, and ``up``, the block's root.

    ``nodes`` has (tree, at, n, hash). A level that the tree does not have is not in ``sides``.
    """
    block = Window.partitionBy("tree", "block").orderBy("at")
    rows = nodes.withColumn("block", F.floor(F.col("at") / BLOCK))
    here, n, step, dropped = "hash", F.col("n"), 1, []
    for level in range(2):
        # At this level a row stands for a node if it is the first one of its subtree.
        number, stands = F.floor(F.col("at") / step), F.col("at") % step == 0
        slot = number % FAN
        length = F.least(F.lit(FAN), n - (number - slot))
        left = [F.when(slot >= j, F.lag(here, j * step).over(block)) for j in range(FAN - 1, 0, -1)]
        right = [F.when(slot + j < length, F.lead(here, j * step).over(block)) for j in range(1, FAN)]
        l, r, exists, up = f"left{level}", f"right{level}", f"exists{level}", f"up{level}"
        rows = rows.withColumns({l: F.concat_ws("", *left), r: F.concat_ws("", *right), exists: n > 1})
        parent = F.when(n > 1, F.sha2(F.concat(here, r).cast("binary"), 256)).otherwise(F.col(here))
        rows = rows.withColumn(up, F.when(stands & (slot == 0), parent))
        if level:  # siblings of the first row hold for all rows of its subtree
            so_far = block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            spread = {c: F.last(F.when(stands, F.col(c)), ignorenulls=True).over(so_far) for c in (l, r)}
            rows = rows.withColumns(spread)
        dropped += [l, r, exists, up]
        here, n, step = up, F.ceil(n / FAN), step * FAN
    sides = [F.when(F.col(f"exists{i}"), F.struct(F.col(f"left{i}").alias("left"), F.col(f"right{i}").alias("right"))) for i in range(2)]
    return rows.withColumns({"sides": F.array_compact(F.array(*sides)), "up": F.col("up1")}).drop(*dropped)


def climbed(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The written nodes of each round, from the leaves on, and (tree, hash) of the roots."""
    rounds = [nodes]
    while True:
        most = rounds[-1].agg(F.max("n")).first()[0] or 0
        if len(rounds) > 1 and most <= 1:
            return rounds[:-1], rounds[-1].select("tree", "hash")
        tops = with_sides(rounds[-1]).where(F.col("at") % BLOCK == 0)
        above = tops.select("tree", F.col("block").alias("at"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("up").alias("hash"))
        rounds.append(written(above, "merkle-round"))


def paths(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The first round's nodes with all their ``sides``, followed by those ``above`` has for their tree, and its ``top``.

    ``above`` is (tree, upper, top). It meets the last round, of at most 256 nodes a tree; from there on sides go down
    from block to block, so no join has a tree for its key.
    """
    keys = ["tree"]
    for nodes in reversed(rounds):
        found = with_sides(nodes).drop("up").join(above, keys).withColumn("sides", F.concat("sides", "upper")).drop("upper", "block")
        keys = ["tree", "block"]
        above = found.select("tree", F.col("at").alias("block"), F.col("sides").alias("upper"), "top")
    return found


def folded(own: Column, sides: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(sides, own, lambda at, s: digest(s["left"], at, s["right"]))


def proof(sides: Column) -> Column:
    """One digest of all siblings, level by level from the leaf, left to right."""
    return digest(F.array_join(F.transform(sides, lambda s: F.concat(s["left"], s["right"])), ""))


def lowered(text: Column) -> Column:
    """``text`` with A-Z in lower case."""
    return F.translate(text, UPPER, UPPER.lower())


def tampered_fifth(key: str, text: str) -> tuple[Column, dict[str, Column]]:
    """Rows whose key, as text, has a checksum that 5 divides, and their texts in lower case."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 5 == 0, F.lit(False)), {text: lowered(F.col(f"`{text}`"))}


def manifest(
    docs: DataFrame,
    key: str = "doc_id",
    group: str = "source",
    columns: Sequence[str] = COLUMNS,
    tampered: tuple[Column, dict[str, Column]] | None = None,
) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    ``tampered`` is a condition and the changed values of the rows it holds for; their ``folded_root`` comes from
    the changed leaf. Without it every row verifies.
    """
    name = F.col(f"`{group}`").cast("string")
    leaves = docs.select(
        F.when(name.isNull(), "-").otherwise(F.concat(F.lit("="), name)).alias("tree"),
        F.col(f"`{key}`").alias("key"),
        leaf(columns).alias("hash"),
        (F.when(tampered[0], leaf(columns, tampered[1])) if tampered else F.lit(None).cast("string")).alias("changed"),
    )
    rounds, subroots = climbed(written(numbered(leaves, ["key", "hash"]), "merkle-leaves"))
    groups = subroots.select(F.lit(WHOLE).alias("tree"), F.col("tree").alias("member"), "hash")
    tops, roots = climbed(written(numbered(groups, ["member"]), "merkle-groups"))
    no_sides = F.array().cast("array<struct<left:string,right:string>>")
    members = paths(tops, roots.select("tree", no_sides.alias("upper"), F.struct(F.col("hash").alias("root")).alias("top")))
    above = members.select(
        F.col("member").alias("tree"), F.col("sides").alias("upper"), F.struct(F.col("hash").alias("subroot"), "top.root").alias("top")
    )
    rows = paths(rounds, written(above, "merkle-tops"))
    rows = rows.withColumn("folded_root", folded(F.coalesce("changed", "hash"), F.col("sides")))
    return rows.select(
        F.col("key").alias(key),
        F.col("hash").alias("leaf"),
        F.col("top.subroot").alias("subroot"),
        F.col("top.root").alias("root"),
        proof(F.col("sides")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("top.root")).alias("verified"),
    )
