"""Rename detection: lost nodes matched to found ones, by equal hashes and then by similar bodies."""

from __future__ import annotations

import difflib
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..mesh import Mesh
from . import mutations

POOL_CAP = 50
THRESHOLD = 0.6
#: So many lost and so many found nodes are compared by one task.
BLOCK = 200
RENAMES = "old_id string, new_id string, renamed_at timestamp, file_path string"
RENAMES_COLUMNS = ("old_id", "new_id", "renamed_at", "file_path")


def body_ratio(old: str | None, new: str | None) -> float:
    """The share of matching characters of two bodies (Ratcliff and Obershelp); 0 if one is missing."""
    return 0.0 if old is None or new is None else difflib.SequenceMatcher(None, old, new).ratio()


def exact_matches(lost: DataFrame, found: DataFrame) -> DataFrame:
    """old_id, new_id, ratio 1.0: a lost and a found node of equal hash, the first of each by id. Null hashes match nothing."""
    a = lost.filter("code_hash is not null").groupBy("code_hash").agg(F.min("id").alias("old_id"))
    b = found.filter("code_hash is not null and is_new").groupBy("code_hash").agg(F.min("id").alias("new_id"))
    return a.join(b, "code_hash").select("old_id", "new_id", F.lit(1.0).alias("ratio"))


def _scored(threshold: float):
    """For applyInPandas: the pairs of a block that reach the threshold."""

    def run(x: pd.DataFrame) -> pd.DataFrame:
        olds, news = list(x[x["lost"]][["id", "body"]].itertuples(index=False)), list(x[~x["lost"]][["id", "body"]].itertuples(index=False))
        out = []
        for n in news:
            m = difflib.SequenceMatcher(None, "", n.body or "")
            for o in olds:
                if n.body is None:
                    r = 0.0
                else:
                    m.set_seq1(o.body)
                    # Both are upper bounds of the ratio.
                    if m.real_quick_ratio() < threshold or m.quick_ratio() < threshold:
                        continue
                    r = m.ratio()
                if r >= threshold:
                    out.append((x["scope"].iloc[0], o.id, n.id, r))
        return pd.DataFrame(out, columns=["scope", "old_id", "new_id", "ratio"])

    return run


def _greedy(x: pd.DataFrame) -> pd.DataFrame:
    """For applyInPandas: pairs by falling ratio, at equal ratios by ids, each node once."""
    used: set[tuple[bool, str]] = set()
    out = []
    for r, o, n in sorted((-p.ratio, p.old_id, p.new_id) for p in x.itertuples()):
        if (True, o) not in used and (False, n) not in used:
            used |= {(True, o), (False, n)}
            out.append((o, n, -r))
    return pd.DataFrame(out, columns=["old_id", "new_id", "ratio"])


def match(lost: DataFrame, found: DataFrame, pool_cap: int | None = POOL_CAP, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """old_id, new_id, ratio, reason for every lost node.

    lost: id, scope, code_hash, body (null if unknown). found: id, scope, code_hash, body, is_new. Equal hashes match first,
    over all scopes; then within a scope pairs by falling ratio, at equal ratios by ids, down to the threshold, each node
    once. Scopes of more than pool_cap nodes (None: no such limit) and lost nodes without a body get no similarity: reason
    says why. A lost node without a partner has a null new_id.

    One task compares at most block lost nodes with block found ones, whatever the size of the scope; the pairs of a scope
    that reach the threshold are then assigned together.
    """
    exact = exact_matches(lost, found)
    left = lost.join(exact.select(F.col("old_id").alias("id")), "id", "left_anti")
    free = found.filter("is_new").join(exact.select(F.col("new_id").alias("id")), "id", "left_anti")
    sizes = left.select("scope", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(free.select("scope", F.lit(0).alias("a"), F.lit(1).alias("b"))).groupBy("scope").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    small = (sizes if pool_cap is None else sizes.filter(F.col("a") + F.col("b") <= pool_cap)).filter("a > 0")
    parts = small.select("scope", F.ceil(F.col("a") / block).cast("int").alias("an"), F.ceil(F.greatest("b", F.lit(1)) / block).cast("int").alias("bn"))
    small = small.select("scope")
    numbers = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # Even blocks by rank: a hash would let some grow beyond the limit.
    rank = F.row_number().over(Window.partitionBy("scope").orderBy("id")) - 1
    olds = left.filter("body is not null").select("scope", "id", "body").withColumn("i", F.floor(rank / block).cast("int")).join(parts, "scope")
    news = free.select("scope", "id", "body").join(small, "scope", "left_semi").withColumn("j", F.floor(rank / block).cast("int")).join(parts, "scope")
    olds = olds.select("scope", "id", "body", F.lit(True).alias("lost"), "i", F.explode(numbers("bn")).alias("j"))
    news = news.select("scope", "id", "body", F.lit(False).alias("lost"), F.explode(numbers("an")).alias("i"), "j")
    scored = olds.unionByName(news).groupBy("scope", "i", "j").applyInPandas(_scored(threshold), "scope string, old_id string, new_id string, ratio double")
    similar = scored.groupBy("scope").applyInPandas(_greedy, "old_id string, new_id string, ratio double")
    matched = exact.unionByName(similar)
    capped = left.join(small, "scope", "left_anti").select("id", F.lit("pool_cap").alias("reason"))
    bare = left.join(small, "scope", "left_semi").filter("body is null").select("id", F.lit("no_body").alias("reason"))
    why = capped.unionByName(bare)
    return lost.select(F.col("id").alias("old_id")).join(matched, "old_id", "left").join(why.withColumnRenamed("id", "old_id"), "old_id", "left").select("old_id", "new_id", "ratio", "reason")


def lost_and_found(nodes: DataFrame, current: DataFrame, renamed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Ids that only earlier snapshots hold, and nodes that no snapshot holds, in the shape match() takes; the scope is the
    file (location), or the project where none is known. What was lost in a file that was renamed (renamed: old_path, path)
    belongs to the scope of the new one."""
    scope = F.coalesce("location", F.substring_index("id", "::", 1))
    lost = current.filter("gone").join(nodes.select("id", "location", F.col("level_2").alias("body")), "id", "left").select("id", scope.alias("scope"), F.col("cur_code").alias("code_hash"), "body")
    if renamed is not None:
        lost = lost.join(renamed.select(F.col("old_path").alias("scope"), "path"), "scope", "left").withColumn("scope", F.coalesce("path", "scope")).drop("path")
    found = nodes.join(current.select("id"), "id", "left_anti").select("id", scope.alias("scope"), F.lower("code_hash").alias("code_hash"), F.col("level_2").alias("body"), F.lit(True).alias("is_new"))
    return lost, found


def renames_of(m: Mesh) -> DataFrame:
    return m.renames if m.renames is not None else m.nodes.sparkSession.createDataFrame([], RENAMES)


def apply_renames(m: Mesh, pairs: DataFrame, at: datetime) -> tuple[Mesh, DataFrame]:
    """Weld pairs (old_id, new_id) that the matcher missed: the index after it, and for each pair applied or the reason why not.

    The old node must be lost (NOT_FOUND), the new one live, and neither may have been renamed before. Of pairs with an end
    in common the first by (old_id, new_id) counts. What is known of the old node moves to the new one, which is RENAMED
    from then on, and the mapping is kept in renames.
    """
    want = pairs.select("old_id", "new_id").distinct()
    a = m.nodes.select(F.col("id").alias("old_id"), F.col("own_status").alias("old_status"))
    b = m.nodes.select(F.col("id").alias("new_id"), F.col("own_status").alias("new_status"), "location")
    done = renames_of(m)
    told = want.join(a, "old_id", "left").join(b, "new_id", "left")
    told = told.join(done.select("new_id", F.lit(True).alias("taken")).distinct(), "new_id", "left").join(done.select("old_id", F.lit(True).alias("left")).distinct(), "old_id", "left")
    reason = (
        F.when(F.col("old_id") == F.col("new_id"), "same_id").when(F.col("old_status").isNull(), "old_not_in_index").when(F.col("new_status").isNull(), "new_not_in_index")
        .when(F.col("old_status") != "NOT_FOUND", F.concat(F.lit("old_status_"), "old_status")).when(F.col("new_status") == "NOT_FOUND", "new_not_live")
        .when(F.col("taken"), "new_already_renamed").when(F.col("left"), "old_already_renamed")
    )
    told = told.withColumn("reason", reason)
    free = told.filter("reason is null")
    firsts = free.groupBy("new_id").agg(F.min("old_id").alias("old_id")).groupBy("old_id").agg(F.min("new_id").alias("new_id"))
    ok = free.join(firsts, ["old_id", "new_id"], "left_semi")
    rest = told.join(firsts.withColumn("won", F.lit(True)), ["old_id", "new_id"], "left")
    lost = F.when(F.col("reason").isNull() & F.col("won").isNull(), "already_renamed").otherwise(F.col("reason"))
    result = rest.select("old_id", "new_id", (F.col("reason").isNull() & F.col("won").isNotNull()).alias("applied"), lost.alias("reason"))
    out = mutations.rename(m, ok.select("old_id", "new_id"))
    moved = ok.select(F.col("new_id").alias("id"), F.lit("RENAMED").alias("own_status"), F.lit(None).cast("string").alias("link_status"))
    event = ok.filter("new_status <> 'RENAMED'").select(F.col("new_id").alias("node_id"), F.lit(at).cast("timestamp").alias("scanned_at"), F.lit("BECAME_RENAMED").alias("change_type"), F.to_json(F.struct(F.col("new_status").alias("from_own"), F.lit(True).alias("manual"))).alias("meta"))
    out = mutations.set_statuses(out, moved)
    more = ok.select("old_id", "new_id", F.lit(at).cast("timestamp").alias("renamed_at"), F.coalesce("location", F.lit("")).alias("file_path"))
    return out.but(history=out.history.unionByName(mutations.events(event, out.history)), renames=done.unionByName(more)), result


def revert_renames(m: Mesh, new_ids: DataFrame, at: datetime) -> tuple[Mesh, DataFrame]:
    """Take renames back by moving everything again from the new id (new_id) to the old one: the index after it, and for each
    id the old one, or no_rename_record. Both nodes are verified afterwards, and the mapping is gone."""
    last = renames_of(m).groupBy("new_id").agg(F.max_by("old_id", F.struct("renamed_at", "old_id")).alias("old_id"))
    told = new_ids.select("new_id").distinct().join(last, "new_id", "left")
    ok = told.filter("old_id is not null")
    out = mutations.rename(m, ok.select(F.col("new_id").alias("old_id"), F.col("old_id").alias("new_id")))
    both = ok.select(F.col("old_id").alias("id")).unionByName(ok.select(F.col("new_id").alias("id"))).distinct()
    out = mutations.set_statuses(out, both.select("id", F.lit("VERIFIED").alias("own_status"), F.lit("VERIFIED").alias("link_status")))
    live = ok.join(m.nodes.select(F.col("id").alias("old_id")), "old_id", "left_semi")
    event = live.select(F.col("old_id").alias("node_id"), F.lit(at).cast("timestamp").alias("scanned_at"), F.lit("BECAME_VERIFIED").alias("change_type"), F.to_json(F.struct(F.col("new_id").alias("reverted_from"))).alias("meta"))
    rest = renames_of(m).join(ok, ["old_id", "new_id"], "left_anti").select(*RENAMES_COLUMNS)
    result = told.select("new_id", "old_id", F.col("old_id").isNotNull().alias("reverted"), F.when(F.col("old_id").isNull(), "no_rename_record").alias("reason"))
    return out.but(history=out.history.unionByName(mutations.events(event, out.history)), renames=rest), result
