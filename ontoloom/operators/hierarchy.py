"""Parent-child rows to full hierarchies, by pointer doubling.

Every node keeps a pointer to an ancestor, the number of steps to it and the path segment
between.  A round joins the pointers that have not reached a root with the state of the
node they point at, which doubles the jump and concatenates the segments, so a tree of
depth d is done after about log2(d) rounds.  Before its roots are reached, each round
settles at least the nodes at depths from 2^k up to 2^(k+1); a round that settles nothing
therefore leaves only nodes whose ancestors run into a cycle.  These few go on jumping
until the set of nodes pointed at stops shrinking: it is then exactly the nodes on cycles.

Each round is a written table (see ``Scratch``), so lineage stays one round long.  Nodes
that are settled are written once and only looked up afterwards; once few are unsettled, only
the rows that these point at are shuffled.  A parent with a third of all children makes a hot
probe side of a join whose other side is unique by node; adaptive execution splits it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ontoloom.sources.scratch import Scratch

#: Most pointers whose targets are sent to all tasks, so that only the rows pointed at are shuffled; more are joined whole.
MOST_POINTERS = 100_000
#: Values of root and depth for nodes on a cycle and for nodes below one.
NO_ROOT, ON_CYCLE, BELOW_CYCLE = -1, -1, -2


def hierarchy(links: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(node, root, depth, path) for each non-null node of ``links``.

    ``path`` lists the nodes from the root to the node itself, both included.  Nodes on a
    cycle (own parents included) have root -1, depth -1 and a null path, nodes below a cycle
    root -1, depth -2 and a null path.  A row with one null end still names a node; repeated
    rows change nothing; of several parents of one node the smallest counts, and the links to the
    others are those of ``further_parents``.  No rows give no rows.  Further columns of ``links`` are ignored.
    """
    scratch = Scratch(links.sparkSession, "hierarchy")
    node, up = F.col(f"`{child}`"), F.col(f"`{parent}`")
    kind = links.schema[child].dataType
    below = F.struct(node.alias("node"), up.alias("up"), F.lit(False).alias("inner"))
    above = F.struct(up.alias("node"), F.lit(None).cast(kind).alias("up"), node.isNotNull().alias("inner"))
    ends = links.select(F.inline(F.array(below, above)))
    nodes = ends.where("node is not null").groupBy("node").agg(F.min("up").alias("up"), F.max("inner").alias("inner"))
    start = nodes.select(
        "node",
        F.coalesce("up", "node").alias("anc"),
        F.when(F.col("up").isNull(), 0).otherwise(1).cast("bigint").alias("steps"),
        F.col("up").isNull().alias("done"),
        "inner",
        F.when(F.col("up").isNull(), F.array().cast(f"array<{kind.simpleString()}>")).otherwise(F.array("node")).alias("path"),
    )
    ended, left = _save(scratch, start, 0)
    schema = T.StructType([*start.schema.fields, T.StructField("round", T.IntegerType())])
    number = 0
    # rows of earlier rounds that are not settled have later versions
    while left:
        state = scratch.read("rounds", schema)
        front = state.where(f"round = {number} and not done")
        # only nodes with children can be pointed at
        known = state.where(f"inner and (done or round = {number})")
        if left <= MOST_POINTERS:
            known = known.join(F.broadcast(front.select(F.col("anc").alias("__anc")).distinct()), F.col("node") == F.col("__anc"), "left_semi")
        number += 1
        ended, left = _save(scratch, _jump(front, known), number)
        if not ended:
            break
    state = scratch.read("rounds", schema)
    trees = state.where("done").select("node", F.col("anc").alias("root"), F.col("steps").alias("depth"), F.concat(F.array("anc"), "path").alias("path"))
    return trees.unionByName(_cyclic(state.where(f"round = {number} and not done").select("node", "anc"), number, left, scratch, trees))


def _save(scratch: Scratch, df: DataFrame, number: int) -> tuple[int, int]:
    """Write a round; how many of its rows are settled and how many not, counted by the write itself.

    The rows are rebalanced first, so that a round of few rows has few files.
    """
    seen = Observation()
    scratch.save(df.observe(seen, F.count_if("done").alias("ended"), F.count_if(~F.col("done")).alias("left")).hint("rebalance"), f"rounds/round={number}")
    return seen.get["ended"], seen.get["left"]


def _jump(front: DataFrame, state: DataFrame) -> DataFrame:
    """A way that meets itself runs into a cycle and will have no path, so its segments, which would double on and on, are dropped."""
    f, s = front.alias("f"), state.alias("s")
    whole = F.concat("s.path", "f.path")
    path = F.when(F.col("s.done"), whole).when(~F.arrays_overlap("s.path", "f.path"), whole)
    return f.join(s, F.col("f.anc") == F.col("s.node")).select("f.node", "s.anc", (F.col("f.steps") + F.col("s.steps")).alias("steps"), "s.done", "f.inner", path.alias("path"))


def _cyclic(left: DataFrame, number: int, size: int, scratch: Scratch, like: DataFrame) -> DataFrame:
    """The rows of the ``size`` nodes on or below a cycle; ``number``: the rounds that made their pointers.

    The nodes pointed at never grow in number as the jump doubles.  Once a doubling leaves their
    number as it is, a jump permutes them, so all of them are on cycles; and cycle nodes are always
    pointed at.
    """
    pointed = left.select("anc").distinct().count() if size else 0
    while pointed:
        number += 1
        a, b = left.alias("a"), left.alias("b")
        left = scratch.save(a.join(b, F.col("a.anc") == F.col("b.node")).select("a.node", "b.anc"), f"cycle{number}")
        scratch.drop(f"cycle{number - 1}")
        before, pointed = pointed, left.select("anc").distinct().count()
        if pointed == before:
            break
    on = left.select(F.col("anc").alias("__on")).distinct()
    kinds = {f.name: f.dataType for f in like.schema}
    return left.join(on, F.col("node") == F.col("__on"), "left").select(
        "node",
        F.lit(NO_ROOT).cast(kinds["root"]).alias("root"),
        F.when(F.col("__on").isNotNull(), ON_CYCLE).otherwise(BELOW_CYCLE).cast("bigint").alias("depth"),
        F.lit(None).cast(kinds["path"]).alias("path"),
    )


def further_parents(links: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(node, parent) for each distinct link that ``hierarchy`` does not follow, as its node has a smaller parent.

    Only the nodes with several parents are joined, with their smallest, so a tree costs one
    aggregation that combines on the map side.  Links with a null end are left out.
    """
    pairs = links.select(F.col(f"`{child}`").alias("node"), F.col(f"`{parent}`").alias("parent")).where("node is not null and parent is not null")
    several = pairs.groupBy("node").agg(F.min("parent").alias("__least"), F.max("parent").alias("__most")).where("__least != __most").select("node", "__least")
    return pairs.join(several, "node").where("parent != __least").select("node", "parent").distinct()


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) from the rows of ``hierarchy``, the node itself left out.

    Reads the paths only, without a join or shuffle; nodes on or below a cycle have no rows.
    """
    steps = tree.select(F.posexplode("path").alias("at", "ancestor"), F.col("node").alias("descendant"), "depth")
    return steps.where(F.col("at") < F.col("depth")).select("ancestor", "descendant", (F.col("depth") - F.col("at")).alias("distance"))


def parent_links(relations: DataFrame, predicates: DataFrame, up: list[str], down: list[str]) -> DataFrame:
    """(child, parent) from graph rows.

    ``predicates`` holds (id, term); ``up`` terms have the child as subject, ``down`` terms the
    parent.  The predicate ids are a small join side, checked against the planner's broadcast
    limit.
    """
    ways = predicates.where(F.col("term").isin(*up, *down)).select(F.col("id").alias("__id"), F.col("term").isin(*up).alias("__up"))
    rows = relations.select("subject", "predicate", "object").join(ways, F.col("predicate") == F.col("__id"))
    return rows.select(F.when(F.col("__up"), F.col("subject")).otherwise(F.col("object")).alias("child"), F.when(F.col("__up"), F.col("object")).otherwise(F.col("subject")).alias("parent"))
