"""Time-ordered operators over the change history."""

from __future__ import annotations

from collections.abc import Collection
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..mesh import Mesh
from ..schema import CODE_CHANGES, CONTENT_EVENTS, KEPT_HISTORY, LINK_EVENTS, STATUS_EVENTS, VERIFY_EVENTS


def latest_change(history: DataFrame, kinds: Collection[str] = CODE_CHANGES) -> DataFrame:
    """node_id, changed_at: the time of the last row (by id) of these kinds; combined before the shuffle, so hot nodes don't skew."""
    return history.filter(F.col("change_type").isin(*kinds)).groupBy("node_id").agg(F.max_by("scanned_at", "id").alias("changed_at"))


def latest_change_times(history: DataFrame, kinds: Collection[str] = CODE_CHANGES) -> DataFrame:
    """node_id, changed_at: the latest time over rows of these kinds."""
    return history.filter(F.col("change_type").isin(*kinds)).groupBy("node_id").agg(F.max("scanned_at").alias("changed_at"))


def newest(history: DataFrame, n: int) -> DataFrame:
    """The n newest rows of each node; the limit is applied before the shuffle as well."""
    w = Window.partitionBy("node_id").orderBy(F.col("id").desc())
    return history.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def retained(history: DataFrame, keep: int = KEPT_HISTORY) -> DataFrame:
    """History after pruning: all preserved rows and the newest of the others of each node."""
    kept = F.coalesce("preserved", F.lit(False))
    return history.filter(kept).unionByName(newest(history.filter(~kept), keep).drop("rn"))


def history_page(history: DataFrame, limit: int, offset: int) -> DataFrame:
    """A page of each node's history, newest first, with the node's total."""
    total = history.groupBy("node_id").agg(F.count("*").alias("total"))
    return newest(history, offset + limit).filter(F.col("rn") > offset).join(total, "node_id")


def resolve_cutoff(history: DataFrame, since_sha: str | None = None, since: datetime | None = None) -> tuple[datetime | None, str | None]:
    """(cutoff, sha) of a reference point: a checkpoint whose sha has the prefix; else the end of the first batch of that sha
    (its kind, within two seconds); a time as given; else the last checkpoint, else the last row with a sha. A sha that is
    not in the history gives (None, None)."""

    def last(rows: DataFrame) -> tuple | None:
        r = rows.agg(F.max_by(F.struct("scanned_at", "git_sha", "change_type"), "id").alias("x")).first()["x"]
        return r and (r["scanned_at"], r["git_sha"])

    points = history.filter("change_type = 'CHECKPOINT'")
    if since_sha:
        if got := last(points.filter(F.col("git_sha").startswith(since_sha))):
            return got
        first = history.filter(F.col("git_sha").startswith(since_sha)).agg(F.min_by(F.struct("scanned_at", "git_sha", "change_type"), "id").alias("x")).first()["x"]
        if first is None:
            return None, None
        same = (F.col("git_sha") == first["git_sha"]) & (F.col("change_type") == first["change_type"])
        end = history.filter(same & F.col("scanned_at").between(first["scanned_at"], first["scanned_at"] + timedelta(seconds=2))).agg(F.max("scanned_at")).first()[0]
        return end or first["scanned_at"], first["git_sha"]
    if since is not None:
        return since, None
    return last(points) or last(history.filter("git_sha is not null")) or (None, None)


def history_since(history: DataFrame, after: datetime | Column | None = None, until: datetime | None = None) -> DataFrame:
    """Rows with after < scanned_at <= until."""
    out = history
    if after is not None:
        out = out.filter(F.col("scanned_at") > after)
    return out.filter(F.col("scanned_at") <= until) if until is not None else out


def stale_windows(history: DataFrame) -> DataFrame:
    """For each CONTENT_ONLY row newer than the node's last change of the description: the newest of a node opens its stale
    window, the others are part of it. By an aggregate per node, so that hot nodes need no sort of their own."""
    desc = history.filter(F.col("change_type").isin("DESC_ONLY", "CONTENT_AND_DESC")).groupBy("node_id").agg(F.max("id").alias("desc_id"))
    content = history.filter("change_type = 'CONTENT_ONLY'")
    top = content.groupBy("node_id").agg(F.max("id").alias("top_id"))
    bounds = top.join(desc, "node_id", "left").filter(F.coalesce("desc_id", F.lit(-1)) < F.col("top_id"))
    out = content.join(bounds, "node_id").filter(F.col("id") > F.coalesce("desc_id", F.lit(-1)))
    return out.select("id", "node_id", "scanned_at", F.when(F.col("id") == F.col("top_id"), "opened").otherwise("ongoing").alias("window_state"))


def baselines(history: DataFrame, depth: int = KEPT_HISTORY) -> DataFrame:
    """node_id, git_sha of the row to compare with: the newest verification or checkpoint with a sha, else the oldest row
    with one, among the newest rows of each node."""
    rows = newest(history, depth).filter("git_sha is not null")
    proven = F.col("change_type").isin(*VERIFY_EVENTS, "CHECKPOINT", "INITIAL")
    a = rows.groupBy("node_id").agg(F.max_by("git_sha", F.when(proven, F.col("id"))).alias("p"), F.max(F.when(proven, 1)).alias("any"), F.min_by("git_sha", "id").alias("o"))
    return a.select("node_id", F.when(F.col("any") == 1, F.col("p")).otherwise(F.col("o")).alias("git_sha"))


def reference_points(history: DataFrame) -> DataFrame:
    """git_sha, kind, first_at, message, row_count: checkpoints, and builds of shas without a checkpoint."""
    rows = history.filter("git_sha is not null and change_type is not null")
    check = rows.filter("change_type = 'CHECKPOINT'").groupBy("git_sha").agg(F.min("scanned_at").alias("first_at"), F.min_by("meta", F.struct("scanned_at", "id")).alias("m"), F.count("*").alias("row_count"))
    check = check.select("git_sha", F.lit("checkpoint").alias("kind"), "first_at", F.get_json_object("m", "$.message").alias("message"), "row_count")
    build = rows.filter("change_type <> 'CHECKPOINT'").groupBy("git_sha").agg(F.min("scanned_at").alias("first_at"), F.count("*").alias("row_count"))
    build = build.join(check.select("git_sha"), "git_sha", "left_anti").select("git_sha", F.lit("build").alias("kind"), "first_at", F.lit(None).cast("string").alias("message"), "row_count")
    return check.unionByName(build)


def report(rows: DataFrame) -> DataFrame:
    """One row of counts over history rows: nodes with changes of content, nodes that became stale or clean, verified nodes,
    those verified by agents alone, and changed links. Every transition but BECAME_VERIFIED counts as becoming stale."""
    kind = F.col("change_type")
    per = rows.groupBy("node_id").agg(
        F.max(kind.isin(*CONTENT_EVENTS)).alias("content"),
        F.max(kind.isin(*STATUS_EVENTS) & (kind != "BECAME_VERIFIED")).alias("stale"),
        F.max(kind == "BECAME_VERIFIED").alias("clean"),
        F.max(kind == "AGENT_VERIFIED").alias("agent"),
        F.max(kind == "MANUAL_VERIFIED").alias("human"),
        F.count_if(kind.isin(*LINK_EVENTS)).alias("links"),
    )
    n = lambda c: F.count_if(c)
    return per.agg(n(F.col("content")).alias("nodes_changed"), n(F.col("stale")).alias("became_stale"), n(F.col("clean")).alias("became_clean"), n(F.col("agent") | F.col("human")).alias("verified"), n(F.col("agent") & ~F.col("human")).alias("agent_only"), F.coalesce(F.sum("links"), F.lit(0)).alias("links_modified"))


def agent_verified(m: Mesh) -> DataFrame:
    """Nodes whose last row other than a checkpoint is a verification by an agent."""
    last = m.history.filter("change_type <> 'CHECKPOINT'").groupBy("node_id").agg(F.max_by(F.struct("change_type", "scanned_at"), "id").alias("x"))
    return last.filter("x.change_type = 'AGENT_VERIFIED'").join(m.nodes.select(F.col("id").alias("node_id"), "title"), "node_id").select("node_id", "title", F.col("x.scanned_at").alias("verified_at"))


def net_diff(m: Mesh, after: datetime) -> DataFrame:
    """node_id, kind since a time: added, content, desc, content+desc or deleted; a node added and deleted since then cancels out."""
    rows = history_since(m.history, after).filter(F.col("change_type").isin(*CONTENT_EVENTS, "DELETED"))
    a = rows.groupBy("node_id").agg(
        F.max_by("change_type", "id").alias("last"),
        F.max(F.col("change_type") == "INITIAL").alias("new"),
        F.max(F.col("change_type").isin("CONTENT_ONLY", "CONTENT_AND_DESC")).alias("code"),
        F.max(F.col("change_type").isin("DESC_ONLY", "CONTENT_AND_DESC")).alias("descr"),
    )
    kind = F.when((F.col("last") == "DELETED") & ~F.col("new"), "deleted").when(F.col("last") == "DELETED", None).when(F.col("new"), "added").when(F.col("code") & F.col("descr"), "content+desc").when(F.col("code"), "content").otherwise("desc")
    return a.select("node_id", kind.alias("kind")).filter("kind is not null")


def live_and_ghosts(m: Mesh, after: datetime) -> DataFrame:
    """Changed nodes that live, and those deleted since then, each once."""
    changed = history_since(m.history, after).filter(F.col("change_type").isin(*CONTENT_EVENTS)).select(F.col("node_id").alias("id")).distinct()
    live = m.nodes.select("id").join(changed, "id", "left_semi")
    gone = history_since(m.history, after).filter("change_type = 'DELETED'").select(F.col("node_id").alias("id")).distinct()
    return live.withColumn("ghost", F.lit(False)).unionByName(gone.join(m.nodes.select("id"), "id", "left_anti").withColumn("ghost", F.lit(True)))
