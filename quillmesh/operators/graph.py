"""Traversals and fixed points over the typed edges."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..mesh import Mesh
from ..runtime import FRAGMENT_ROWS, Heavy, cut, extend, release, salted_join
from ..schema import LINK, OWN, severity

MOST_LEVELS = 32


def grow(start: DataFrame, key: list[str], step: Callable[[DataFrame], DataFrame], levels: int | None = MOST_LEVELS) -> DataFrame:
    """All rows reachable from start by step, each key once, at its first level (column level, 0 for start).

    Only rows found in the last round go into the next one; a round's rows are written, so that plans stay short and
    survive lost executors. Ends when a round finds nothing new or after `levels` rounds, if given.
    """
    seen = cut(start.select(*key).distinct().withColumn("level", F.lit(0)))
    front = seen
    for level in count(1) if levels is None else range(1, levels + 1):
        new = step(front.select(*key)).select(*key).distinct().join(seen.select(*key), key, "left_anti")
        seen, front = extend(seen, new.withColumn("level", F.lit(level)))
        if front.isEmpty():
            break
    return seen


def khop_nodes(m: Mesh, node_id: str, direction: str = "out", depth: int = 1) -> DataFrame:
    """id, level of the nodes within depth hops (the start at level 0), whether they exist or not."""
    out = m.edges.select(F.col("from_id").alias("id"), F.col("to_id").alias("nxt"))
    back = m.edges.select(F.col("to_id").alias("id"), F.col("from_id").alias("nxt"))
    hops = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    start = m.edges.sparkSession.createDataFrame([(node_id,)], "id string")
    # A semi-join by an end goes below the merging of repeated edges: the few found ids filter the scan, no edge is shuffled.
    return grow(start, ["id"], lambda f: hops.join(f, "id", "left_semi").select(F.col("nxt").alias("id")), depth)


def khop_edges(m: Mesh, node_id: str, direction: str = "out", depth: int = 1) -> DataFrame:
    """Edges that leave (or enter, or touch) a node less than depth hops from the start, each once, with their level."""
    near = khop_nodes(m, node_id, direction, depth - 1).select("id", "level")
    ends = {"out": ["from_id"], "in": ["to_id"], "both": ["from_id", "to_id"]}[direction]
    hit = None
    for end in ends:
        mine = m.edges.select("id", "edge_type", "from_id", "to_id").join(near.select(F.col("id").alias(end)), end, "left_semi")
        part = mine.join(near.select(F.col("id").alias(end), (F.col("level") + 1).alias("hop")), end).select("id", "edge_type", "from_id", "to_id", "hop")
        hit = part if hit is None else hit.unionByName(part)
    return hit.groupBy("id", "edge_type", "from_id", "to_id").agg(F.min("hop").alias("hop"))


def fetch_graph(m: Mesh, node_id: str, direction: str = "out", depth: int = 1, most: int = 40, offset: int = 0) -> DataFrame:
    """A page of khop_edges by hop and id, each row with the total and truncated; no rows for a node that there isn't."""
    rows = cut(khop_edges(m, node_id, direction, depth).join(F.broadcast(m.nodes.filter(F.col("id") == node_id).select(F.lit(True).alias("known"))), F.lit(True), "left_semi"))  # one row
    total = rows.agg(F.count("*").alias("total"), (F.count("*") > offset + most).alias("truncated"))
    return rows.orderBy("hop", "id").offset(offset).limit(most).crossJoin(F.broadcast(total))  # one row


def neighbourhood(m: Mesh, node_id: str, depth: int = 1) -> DataFrame:
    """Existing nodes within depth hops either way, with their statuses."""
    return m.nodes.join(khop_nodes(m, node_id, "both", depth), "id").select("id", "level", "own_status", "link_status")


def task_hops(m: Mesh) -> DataFrame:
    """env, task, nxt: an envelope's autosteps' targets and the envelopes that annotate those (null for none).

    A step has one target: of several the first by id."""
    auto = m.nodes.filter("subtype = 'autostep'").select(F.col("id").alias("step"))
    steps = m.edges.filter("edge_type = 'composes'").select(F.col("from_id").alias("env"), F.col("to_id").alias("step")).join(auto, "step", "left_semi")
    to = m.edges.filter("edge_type = 'delegates_to'").groupBy(F.col("from_id").alias("step")).agg(F.min("to_id").alias("task"))
    up = m.edges.filter("edge_type = 'annotates'").select(F.col("to_id").alias("task"), F.col("from_id").alias("nxt"))
    return steps.join(to, "step").select("env", "task").distinct().join(up, "task", "left")


def delegating(m: Mesh) -> DataFrame:
    """id, updated_at of workflow and task envelopes."""
    return m.nodes.filter("node_type = 'composite_process' and subtype in ('workflow', 'task')").select("id", "updated_at")


def reachable_tasks(m: Mesh, envelopes: DataFrame, levels: int | None = MOST_LEVELS) -> DataFrame:
    """env, task: tasks each envelope reaches through its autosteps, their targets and those targets' envelopes, over at most
    `levels` delegations (None: however many there are)."""
    hops = cut(task_hops(m))
    nxt = hops.filter("nxt is not null").select("env", "nxt").distinct()
    start = envelopes.select(F.col("id").alias("env"), F.col("id").alias("at"))
    near = grow(start, ["env", "at"], lambda f: f.join(nxt.select(F.col("env").alias("at"), "nxt"), "at").select("env", F.col("nxt").alias("at")), levels and levels - 1)
    return near.join(hops.select(F.col("env").alias("at"), "task").distinct(), "at").select("env", "task").distinct()


def stale_by_delegation(m: Mesh, changes: DataFrame, reach: DataFrame | None = None) -> DataFrame:
    """id, via: workflow and task envelopes that reach (reach: env, task) a task whose code changed after the envelope was
    updated."""
    env = delegating(m)
    hit = (reachable_tasks(m, env) if reach is None else reach).join(changes, F.col("task") == F.col("node_id")).join(env.withColumnRenamed("id", "env"), "env")
    return hit.filter("changed_at > updated_at").select(F.col("env").alias("id"), F.col("task").alias("via"))


#: kind: P a waiting parent with its own severities and the worst so far below it, E an edge between two such, D a settled one.
_WAITING = "kind string, id string, child string, own int, link int, wo int, wl int, atomic boolean"
_WAITING_ARROW = pa.schema([("kind", pa.string()), ("id", pa.string()), ("child", pa.string()), *[(c, pa.int32()) for c in ("own", "link", "wo", "wl")], ("atomic", pa.bool_())])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Settle the parents of one fragment whose children are settled, in the order from the leaves up."""
    parents: dict[str, list] = {}
    edges: list[tuple[str, str]] = []
    for b in batches:
        for kind, id_, child, *rest in zip(*(b.column(c).to_pylist() for c in _WAITING_ARROW.names), strict=True):
            if kind == "P":
                parents[id_] = rest
            else:
                edges.append((id_, child))
    left = Counter(p for p, _ in edges)
    up: dict[str, list[str]] = defaultdict(list)
    for p, c in edges:
        if c in parents:
            up[c].append(p)
    ready = [p for p in parents if not left[p]]
    done: dict[str, tuple[int, int]] = {}
    while ready:
        p = ready.pop()
        own, _, wo, wl, atomic = parents[p]
        done[p] = (own, max(wl, 1) if wo or wl else wl) if atomic else (wo, wl)
        for q in up[p]:
            parents[q][2], parents[q][3] = max(parents[q][2], done[p][0]), max(parents[q][3], done[p][1])
            left[q] -= 1
            if not left[q]:
                ready.append(q)
    rows = [("D", p, None, o, w, None, None, None) for p, (o, w) in done.items()]
    rows += [("P", p, None, *v) for p, v in parents.items() if p not in done]
    rows += [("E", p, c, None, None, None, None, None) for p, c in edges if p not in done and c not in done]
    for i in range(0, len(rows), 1 << 14):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + (1 << 14)], strict=True), _WAITING_ARROW.types, strict=True)], schema=_WAITING_ARROW)


def inherit(m: Mesh, statuses: DataFrame, fragment_rows: int = FRAGMENT_ROWS) -> DataFrame:
    """id, own, link (severities) after composites took the worst of their children, from the leaves up.

    A composite takes the worst own and link severity of itself and its children. An atomic parent keeps its own; its link
    takes the worst link, and is stale at least if anything in or under it isn't verified. Nodes in and above circles of
    composes edges keep what they had. statuses: id, own, link; ids without a row count as 0.

    What leaves say is aggregated per parent first. The edges between parents are dealt in sorted ranges of fragment_rows,
    each settled by one task as far as it goes; what the fragments need of each other is joined, and the rest goes round
    again until nothing is settled any more. Parents with more children than a fragment are settled by the joins alone.
    """
    zero = lambda *cs: [F.coalesce(F.col(c), F.lit(0)).cast("int") for c in cs]
    edges = cut(m.edges.filter("edge_type = 'composes'").select(F.col("from_id").alias("id"), F.col("to_id").alias("child")))
    told = cut(statuses.select("id", "own", "link"))
    inner = edges.join(edges.select(F.col("id").alias("child")).distinct(), "child", "left_semi").select("id", "child")
    leaves = edges.join(edges.select(F.col("id").alias("child")).distinct(), "child", "left_anti")
    worst = leaves.join(told.withColumnRenamed("id", "child"), "child").groupBy("id").agg(F.max("own").alias("co"), F.max("link").alias("cl"))
    o, link = zero("own", "link")
    co, cl = zero("co", "cl")
    waiting = edges.select("id").distinct().join(m.nodes.select("id", "node_type"), "id", "left").join(told, "id", "left").join(worst, "id", "left")
    waiting = waiting.select(F.lit("P").alias("kind"), "id", F.lit(None).cast("string").alias("child"), o.alias("own"), link.alias("link"), F.greatest(o, co).alias("wo"), F.greatest(link, cl).alias("wl"), F.col("node_type").eqNullSafe("atomic_process").alias("atomic"))
    none = [F.lit(None).cast("int").alias(c) for c in ("own", "link", "wo", "wl")]
    state = cut(waiting.unionByName(inner.select(F.lit("E").alias("kind"), "id", "child", *none, F.lit(None).cast("boolean").alias("atomic"))))
    settled: list[DataFrame] = []
    while True:
        n = state.count()
        pieces = math.ceil(n / fragment_rows)
        big = state.limit(0).select("id") if n <= fragment_rows else state.filter("kind = 'E'").groupBy("id").count().filter(F.col("count") > fragment_rows).select("id")
        kept = state.join(F.broadcast(big), "id", "left_semi").select(*state.columns) if pieces > 1 else None  # at most n / fragment_rows ids
        local = state if kept is None else state.join(F.broadcast(big), "id", "left_anti").select(*state.columns)
        local = local.repartitionByRange(pieces, "id") if pieces > 1 else local.coalesce(1)
        out = local.mapInArrow(_settle, _WAITING)
        if kept is not None:
            lone = kept.join(kept.filter("kind = 'E'").select("id").distinct(), "id", "left_anti")
            worse = (F.col("wo") > 0) | (F.col("wl") > 0)
            by_join = lone.select(F.lit("D").alias("kind"), "id", "child", F.when(F.col("atomic"), F.col("own")).otherwise(F.col("wo")).alias("own"), F.when(F.col("atomic") & worse, F.greatest("wl", F.lit(1))).otherwise(F.col("wl")).alias("link"), *none[2:], "atomic")
            out = out.unionByName(by_join).unionByName(kept.join(lone.select("id"), "id", "left_anti").select(*state.columns))
        out = cut(out)
        fresh = out.filter("kind = 'D'").select("id", "own", "link")
        settled.append(fresh)
        open_ = out.filter("kind = 'E'").select("id", "child")
        if open_.isEmpty() or fresh.isEmpty():
            break
        heavy = Heavy(open_.groupBy("child").agg(F.count("*").alias("n")), "child", "n")
        told_now = cut(salted_join(open_, fresh.select(F.col("id").alias("child"), F.col("own").alias("co"), F.col("link").alias("cl")), "child", heavy, F.col("id"), "left"))
        news = told_now.filter("co is not null").groupBy("id").agg(F.max("co").alias("co"), F.max("cl").alias("cl"))
        parents = out.filter("kind = 'P'").join(news, "id", "left").withColumn("wo", F.greatest("wo", co)).withColumn("wl", F.greatest("wl", cl)).select(*state.columns)
        state = cut(parents.unionByName(told_now.filter("co is null").select(F.lit("E").alias("kind"), "id", "child", *none, F.lit(None).cast("boolean").alias("atomic"))))
        if told_now.filter("co is not null").isEmpty():
            break
    final = reduce(DataFrame.unionByName, settled).select("id", F.col("own").alias("o"), F.col("link").alias("l"))
    return told.join(final, "id", "full_outer").select("id", F.coalesce("o", "own").cast("int").alias("own"), F.coalesce("l", "link").cast("int").alias("link"))


def expanded_steps(m: Mesh, levels: int | None = None) -> DataFrame:
    """Steps of every workflow envelope, and in the place of a delegating step those of the envelope of its target:
    root, path (dotted number), step, target, inner (the envelope of the target), cyclic. A target already on the path is not entered again, which ends every
    chain; levels, if given, ends them sooner."""
    kinds = m.nodes.filter("subtype in ('step', 'autostep')").select(F.col("id").alias("step"))
    to = m.edges.filter("edge_type = 'delegates_to'").groupBy(F.col("from_id").alias("step")).agg(F.min("to_id").alias("target"))
    of = m.edges.filter("edge_type = 'annotates'").groupBy(F.col("to_id").alias("target")).agg(F.min("from_id").alias("inner"))
    own = m.edges.filter("edge_type = 'composes'").select(F.col("from_id").alias("env"), F.col("to_id").alias("step")).join(kinds, "step", "left_semi")
    number = fn.step_parts(F.regexp_extract("step", r"::step-([0-9.]+)$", 1))
    own = cut(own.join(to, "step", "left").join(of, "target", "left").select("env", "step", number.alias("no"), "target", "inner"))
    roots = m.nodes.filter("subtype = 'workflow'").select(F.col("id").alias("root"))
    front = roots.join(own, roots.root == own.env).select("root", F.col("no").alias("path"), "step", "target", "inner", F.array("root").alias("on"))
    front = cut(front.withColumn("cyclic", F.coalesce(F.array_contains("on", F.col("inner")), F.lit(False))))
    rows = front
    for _ in count() if levels is None else range(levels):
        nxt = front.filter("inner is not null and not cyclic").select("root", F.col("path").alias("p"), F.col("inner").alias("env"), F.concat("on", F.array("inner")).alias("on")).join(own, "env")
        nxt = nxt.select("root", F.concat("p", "no").alias("path"), "step", "target", "inner", "on").withColumn("cyclic", F.coalesce(F.array_contains("on", F.col("inner")), F.lit(False)))
        front = cut(nxt)
        if front.isEmpty():
            break
        rows = rows.unionByName(front)
    return rows.select("root", F.array_join(F.transform("path", lambda x: x.cast("string")), ".").alias("path"), "step", "target", "inner", "cyclic")


def machine_transitions(m: Mesh) -> DataFrame:
    """Transitions between states: machine, from, to, how, event."""
    state = F.regexp_extract("from_id", r"^(.*@machine)\.states\.", 1)
    return m.edges.filter("edge_type = 'delegates_to' and via is not null").withColumn("machine", state).filter("machine <> ''").select("machine", F.col("from_id").alias("state"), F.col("to_id").alias("target"), "via", "event")


def severities(statuses: DataFrame) -> DataFrame:
    return statuses.select("id", severity("own_status", OWN).alias("own"), severity("link_status", LINK).alias("link"))
