"""Parent-child links to full hierarchies: fragments of the forest are contracted, the rest is solved recursively."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import FRAGMENT_ROWS, Heavy, blank, cut, parallelism, salted_join

#: node: the id. ptr: the nearest ancestor not yet followed, null once the root is known. w: steps to ptr, or to the root.
#: low: the smallest id from node up to before ptr. root: the root, or the smallest id of the circle. circle: root is one
#: of a circle. path: ids below ptr down to node (from the root itself once that is known); null in or below circles.
LINKS = T.StructType(
    [
        T.StructField("node", T.StringType()),
        T.StructField("ptr", T.StringType()),
        T.StructField("w", T.LongType()),
        T.StructField("low", T.StringType()),
        T.StructField("root", T.StringType()),
        T.StructField("circle", T.BooleanType()),
        T.StructField("path", T.ArrayType(T.StringType())),
    ]
)
ARROW = pa.schema([("node", pa.string()), ("ptr", pa.string()), ("w", pa.int64()), ("low", pa.string()), ("root", pa.string()), ("circle", pa.bool_()), ("path", pa.list_(pa.string()))])


def parent_links(edges: DataFrame, child: str, parent: str, edge_id: str, at: str) -> DataFrame:
    """node, parent: a row per id that stands at either end of an edge, with its one parent or null.

    An edge's time is the earliest `at` of its id. Of several parents that of the latest edge counts, at equal times
    the smaller id. Edges with a null or blank end are left out; repeated edges count once.
    """
    ok = edges.filter(~blank(child) & ~blank(parent))
    once = ok.groupBy(F.col(edge_id).alias("e"), F.col(child).alias("c"), F.col(parent).alias("p")).agg(F.min(at).alias("t"))
    best = F.min(F.struct((-F.coalesce(F.unix_micros("t"), F.lit(-(2**62)))).alias("late"), "p"))
    chosen = once.groupBy(F.col("c").alias("node")).agg(best.alias("b")).select("node", F.col("b.p").alias("parent"))
    above = once.select(F.col("p").alias("node"), F.lit(None).cast("string").alias("parent"))
    return chosen.unionByName(above).groupBy("node").agg(F.max("parent").alias("parent"))


def _contract(with_paths: bool):
    """Follow all links within one partition: each row's ptr moves out of the fragment, or its root becomes known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row: dict[str, list] = {}
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ARROW.names]
            for node, ptr, w, low, root, circle, path in zip(*cols, strict=True):
                row[node] = [ptr, w, low, root, circle, path]
        # Rows whose chain is followed to its end; a row is final if its ptr is null or lies outside.
        done: set[str] = set()
        for start in row:
            if start in done:
                continue
            chain, where, x = [], {}, start
            while x in row and x not in done and row[x][0] is not None and x not in where:
                where[x] = len(chain)
                chain.append(x)
                x = row[x][0]
            if x in where:  # a circle within the fragment
                ring = chain[where[x] :]
                least = min(row[y][2] for y in ring)
                for y in ring:
                    row[y] = [None, -1, row[y][2], least, True, None]
                    done.add(y)
                del chain[where[x] :]
            elif x in row:
                done.add(x)
            for y in reversed(chain):
                ptr, w, low, _, _, path = row[y]
                if ptr in row:
                    a = row[ptr]
                    if a[4]:
                        row[y] = [None, -1, low, a[3], True, None]
                    else:
                        row[y] = [a[0], w + a[1], min(low, a[2]) if a[0] is not None else low, a[3], False, a[5] + path if with_paths else None]
                done.add(y)
        out = [(n, *v) for n, v in row.items()]
        step = 1 << 14
        for i in range(0, len(out), step):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + step], strict=True), ARROW.types, strict=True)], schema=ARROW)

    return run


def _expand(links: DataFrame, solved: DataFrame, with_paths: bool) -> DataFrame:
    """Put the solution of the exits under the rows that end in them."""
    known = links.filter("ptr is null")
    open_ = links.filter("ptr is not null")
    heavy = Heavy(open_.groupBy("ptr").agg(F.count("*").alias("n")), "ptr", "n")
    up = solved.select(F.col("node").alias("ptr"), F.col("w").alias("w2"), F.col("root").alias("r2"), F.col("circle").alias("c2"), F.col("path").alias("p2"))
    got = salted_join(open_, up, "ptr", heavy, F.col("node")).select(
        "node",
        F.lit(None).cast("string").alias("ptr"),
        F.when(F.col("c2"), F.lit(-1)).otherwise(F.col("w") + F.col("w2")).cast("long").alias("w"),
        "low",
        F.col("r2").alias("root"),
        F.col("c2").alias("circle"),
        (F.when(~F.col("c2"), F.concat("p2", "path")) if with_paths else F.lit(None).cast("array<string>")).alias("path"),
    )
    return known.unionByName(got)


def _deal(links: DataFrame, pieces: int, turn: int) -> DataFrame:
    """Fragments: sorted ranges of ids at turn 0; later random mates, a row that draws tails going to the fragment of a parent
    that draws heads, so that a quarter of all links lie within a fragment whatever the ids say. Children of heavy parents
    stay where their own id puts them."""
    if turn == 0:
        return links.repartitionByRange(pieces, "node")
    heads = lambda c: F.pmod(F.xxhash64(F.lit(turn), c), F.lit(2)) == 0
    heavy = Heavy(links.filter("ptr is not null").groupBy("ptr").agg(F.count("*").alias("n")), "ptr", "n")
    told = heavy.told(links, "ptr", F.col("node"))
    mate = F.col("ptr").isNotNull() & ~heads(F.col("node")) & heads(F.col("ptr")) & (F.col("_salts") == 1)
    return told.repartition(pieces, F.when(mate, F.col("ptr")).otherwise(F.col("node"))).select(*links.columns)


def _solve(links: DataFrame, n: int, fragment_rows: int, with_paths: bool, top: bool = False, turn: int = 0) -> DataFrame:
    pieces = math.ceil(n / fragment_rows)
    if top:  # enough tasks for all cores
        pieces = max(pieces, min(2 * parallelism(links.sparkSession), math.ceil(n / 5000)))
    dealt = _deal(links, pieces, turn) if pieces > 1 else links.coalesce(1)
    local = dealt.mapInArrow(_contract(with_paths), LINKS)
    if pieces <= 1:
        return local
    local = cut(local)
    exits = local.filter("ptr is not null").select(F.col("ptr").alias("node")).distinct()
    quotient = cut(local.join(exits, "node", "left_semi"))
    m = quotient.count()
    if m == 0:
        return local
    # Where sorted ranges keep most of the links outside, the next fragments are dealt anew.
    return _expand(local, _solve(quotient, m, fragment_rows, with_paths, turn=turn + (turn > 0 or m > 0.7 * n)), with_paths)


def hierarchy(links: DataFrame, fragment_rows: int = FRAGMENT_ROWS, with_paths: bool = False) -> DataFrame:
    """The place of every id in the forest. links: node (unique, not null), parent or null.

    node_id, root_id, depth (0 for a root), in_circle, path (root first, itself last; null without with_paths and for
    ids in or below a circle). For those, root_id is the smallest id of the circle (by code point) and depth is -1.
    Every parent must have a row of its own, as parent_links gives it. An id that is its own parent is a circle of one.

    Ids are dealt in sorted ranges of fragment_rows, in which ids of one project and file lie together. Within a
    range each chain is followed to its end or to the first ancestor in another range (the exit). The exits with
    their contracted links form a smaller forest, which is solved in the same way; its solution is then put under
    the fragments. Where sorted ranges hardly shrink it (ids in no useful order), the next fragments join random mates.
    """
    every = links.filter("node is not null")
    start = every.select(
        "node",
        F.col("parent").alias("ptr"),
        F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("w"),
        F.col("node").alias("low"),
        F.when(F.col("parent").isNull(), F.col("node")).alias("root"),
        F.lit(False).alias("circle"),
        (F.array("node") if with_paths else F.lit(None).cast("array<string>")).alias("path"),
    )
    start = cut(start)
    out = _solve(start, start.count(), fragment_rows, with_paths, True)
    return out.select(F.col("node").alias("node_id"), F.col("root").alias("root_id"), F.col("w").cast("int").alias("depth"), F.col("circle").alias("in_circle"), "path")


def _on_circles(links: DataFrame, n: int) -> DataFrame:
    """node: the ids on the circles themselves. links: node, parent of n ids in or below circles.

    After n steps up every id is on its circle, and each id of a circle is reached from another of it.
    """
    hop = links.select("node", F.col("parent").alias("ptr"))
    for _ in range(math.ceil(math.log2(max(n, 2)))):
        heavy = Heavy(hop.groupBy("ptr").agg(F.count("*").alias("n")), "ptr", "n")
        far = hop.select(F.col("node").alias("ptr"), F.col("ptr").alias("ptr2"))
        hop = cut(salted_join(hop, far, "ptr", heavy, F.col("node")).select("node", F.col("ptr2").alias("ptr")))
    return hop.select(F.col("ptr").alias("node")).distinct()


def all_paths(links: DataFrame, fragment_rows: int = FRAGMENT_ROWS) -> DataFrame:
    """The rows of hierarchy(with_paths=True), in which ids below a circle have a path too: from the first id outside the
    circle. Their root_id and depth (-1) stay; ids in circles have no path."""
    placed = cut(hierarchy(links, fragment_rows, True))
    lost = cut(links.join(placed.filter("in_circle").select(F.col("node_id").alias("node")), "node", "left_semi").select("node", "parent"))
    n = lost.count()
    if n == 0:
        return placed
    ring = cut(_on_circles(lost, n))
    below = lost.join(ring, "node", "left_anti").join(ring.select(F.col("node").alias("parent"), F.lit(True).alias("entry")), "parent", "left")
    trees = hierarchy(below.select("node", F.when(F.col("entry").isNull(), F.col("parent")).alias("parent")), fragment_rows, True)
    hung = placed.filter("in_circle").drop("path").join(trees.select("node_id", "path"), "node_id", "left")
    return placed.filter("not in_circle").unionByName(hung)


def descendants(placed: DataFrame) -> DataFrame:
    """ancestor_id, node_id, distance: each id under each of its ancestors. placed: the rows of hierarchy(with_paths=True),
    or of all_paths(), which gives those below circles too.

    As many rows as the paths have steps; ids in circles are neither ancestors nor descendants in this sense.
    """
    steps = F.size("path") - 1
    up = placed.filter(F.col("path").isNotNull() & (steps > 0))
    ex = up.select("node_id", steps.alias("steps"), F.posexplode(F.slice("path", F.lit(1), steps)).alias("pos", "ancestor_id"))
    return ex.select("ancestor_id", "node_id", (F.col("steps") - F.col("pos")).cast("int").alias("distance"))


def composes_links(edges: DataFrame) -> DataFrame:
    """parent_links of the composes rows of edges; edge_type is read without regard to case and outer blanks."""
    kind = F.lower(F.regexp_replace("edge_type", r"(?U)^\s+|\s+$", ""))
    return parent_links(edges.filter(kind == "composes"), "to_id", "from_id", "id", "loaded_at")
