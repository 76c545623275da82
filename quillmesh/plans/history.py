"""Queries and SQL over the change history."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..mesh import Mesh
from ..operators import history as hs
from .registry import registry, us

QUERIES, SQL, add = registry()
SINCE = datetime(2024, 9, 1)
_T = "TIMESTAMPTZ '2024-09-01 00:00:00+00'"
_CODE = "('CONTENT_ONLY', 'CONTENT_AND_DESC', 'BECAME_CONTENT_UPDATED')"

add("win1_latest_change", lambda m: hs.latest_change(m.history).select("node_id", us("changed_at").alias("changed_us")), f"SELECT node_id, epoch_us(scanned_at) AS changed_us FROM h WHERE change_type IN {_CODE} QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY id DESC) = 1")
add("agg4_change_times", lambda m: hs.latest_change_times(m.history).select("node_id", us("changed_at").alias("changed_us")), f"SELECT node_id, epoch_us(max(scanned_at)) AS changed_us FROM h WHERE change_type IN {_CODE} GROUP BY 1")
add("win2_retention", lambda m: hs.retained(m.history, 5).select("id", "node_id"), "SELECT id, node_id FROM h WHERE preserved UNION ALL (SELECT id, node_id FROM h WHERE NOT coalesce(preserved, false) QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY id DESC) <= 5)")
add("win3_newest", lambda m: hs.newest(m.history, 3).select("id", "node_id", "rn"), "SELECT id, node_id, row_number() OVER (PARTITION BY node_id ORDER BY id DESC) AS rn FROM h QUALIFY rn <= 3")
add("win4_history_page", lambda m: hs.history_page(m.history, 2, 1).select("id", "node_id", "total"), "SELECT id, node_id, count(*) OVER (PARTITION BY node_id) AS total FROM h QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY id DESC) BETWEEN 2 AND 3")


def _cutoff(m: Mesh):
    at, sha = hs.resolve_cutoff(m.history)
    return m.history.filter(F.col("scanned_at") > F.lit(at)).groupBy("change_type").agg(F.count("*").alias("n")).withColumn("sha", F.lit(sha))


add("win5_cutoff", _cutoff, "c AS (SELECT scanned_at, git_sha FROM h WHERE change_type = 'CHECKPOINT' ORDER BY id DESC LIMIT 1) SELECT change_type, count(*) AS n, any_value(c.git_sha) AS sha FROM h, c WHERE h.scanned_at > c.scanned_at GROUP BY 1")
add("win6_since", lambda m: hs.history_since(m.history, SINCE, datetime(2024, 12, 1)).select("id", "node_id", "change_type"), f"SELECT id, node_id, change_type FROM h WHERE scanned_at > {_T} AND scanned_at <= TIMESTAMPTZ '2024-12-01 00:00:00+00'")
add("win7_stale_windows", lambda m: hs.stale_windows(m.history).select("id", "node_id", "window_state"),
    """x AS (SELECT id, node_id, max(CASE WHEN change_type IN ('DESC_ONLY', 'CONTENT_AND_DESC') THEN 1 ELSE 0 END) OVER (PARTITION BY node_id ORDER BY id DESC ROWS UNBOUNDED PRECEDING) AS closed, change_type FROM h)
    SELECT id, node_id, CASE WHEN row_number() OVER (PARTITION BY node_id ORDER BY id DESC) = 1 THEN 'opened' ELSE 'ongoing' END AS window_state FROM x WHERE closed = 0 AND change_type = 'CONTENT_ONLY'""")  # fmt: skip
add("win8_baselines", lambda m: hs.baselines(m.history),
    """r AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY id DESC) AS rn FROM h), q AS (SELECT * FROM r WHERE rn <= 100 AND git_sha IS NOT NULL)
    SELECT node_id, coalesce(arg_max(git_sha, id) FILTER (change_type IN ('AGENT_VERIFIED', 'MANUAL_VERIFIED', 'CHECKPOINT', 'INITIAL')), arg_min(git_sha, id)) AS git_sha FROM q GROUP BY 1""")  # fmt: skip
add("agg5_reference_points", lambda m: hs.reference_points(m.history).select("git_sha", "kind", us("first_at").alias("first_us"), "message", "row_count"),
    """c AS (SELECT git_sha, min(scanned_at) AS f, arg_min(meta, (scanned_at, id)) AS m, count(*) AS row_count FROM h WHERE change_type = 'CHECKPOINT' AND git_sha IS NOT NULL GROUP BY 1)
    SELECT git_sha, 'checkpoint' AS kind, epoch_us(f) AS first_us, json_extract_string(m, '$.message') AS message, row_count FROM c
    UNION ALL SELECT git_sha, 'build', epoch_us(min(scanned_at)), NULL, count(*) FROM h WHERE change_type <> 'CHECKPOINT' AND git_sha IS NOT NULL AND git_sha NOT IN (SELECT git_sha FROM c) GROUP BY 1""")  # fmt: skip
add("agg6_indexed_shas", lambda m: m.history.filter("git_sha is not null").select("git_sha").distinct(), "SELECT DISTINCT git_sha FROM h WHERE git_sha IS NOT NULL")
add("agg7_head_sha", lambda m: m.history.filter("git_sha is not null").agg(F.max_by("git_sha", "id").alias("git_sha")), "SELECT arg_max(git_sha, id) AS git_sha FROM h WHERE git_sha IS NOT NULL")
_REPORT = """SELECT count(DISTINCT node_id) FILTER (change_type IN ('INITIAL', 'CONTENT_ONLY', 'DESC_ONLY', 'CONTENT_AND_DESC')) AS nodes_changed,
count(DISTINCT node_id) FILTER (change_type IN ('BECAME_CONTENT_UPDATED', 'BECAME_DESC_UPDATED', 'BECAME_NOT_FOUND', 'BECAME_RENAMED', 'BECAME_LINKED_STALE', 'BECAME_BROKEN_LINK', 'LINK_BECAME_VERIFIED')) AS became_stale,
count(DISTINCT node_id) FILTER (change_type = 'BECAME_VERIFIED') AS became_clean, count(DISTINCT node_id) FILTER (change_type IN ('AGENT_VERIFIED', 'MANUAL_VERIFIED')) AS verified,
count(DISTINCT node_id) FILTER (change_type = 'AGENT_VERIFIED' AND node_id NOT IN (SELECT node_id FROM r WHERE change_type = 'MANUAL_VERIFIED')) AS agent_only, count(*) FILTER (change_type IN ('LINK_ADDED', 'LINK_REMOVED')) AS links_modified FROM r"""
add("agg11_report", lambda m: hs.report(hs.history_since(m.history, SINCE)), f"r AS (SELECT * FROM h WHERE scanned_at > {_T}) {_REPORT}")
add("jn9_agent_verified", lambda m: hs.agent_verified(m).select("node_id", "title", us("verified_at").alias("verified_us")),
    "x AS (SELECT * FROM h WHERE change_type <> 'CHECKPOINT' QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY id DESC) = 1) SELECT node_id, title, epoch_us(scanned_at) AS verified_us FROM x JOIN n ON n.id = x.node_id WHERE change_type = 'AGENT_VERIFIED'")
add("jn21_net_diff", lambda m: hs.net_diff(m, SINCE),
    f"""x AS (SELECT node_id, arg_max(change_type, id) AS l, bool_or(change_type = 'INITIAL') AS nw, bool_or(change_type IN ('CONTENT_ONLY', 'CONTENT_AND_DESC')) AS c, bool_or(change_type IN ('DESC_ONLY', 'CONTENT_AND_DESC')) AS d
      FROM h WHERE scanned_at > {_T} AND change_type IN ('INITIAL', 'CONTENT_ONLY', 'DESC_ONLY', 'CONTENT_AND_DESC', 'DELETED') GROUP BY 1)
    SELECT node_id, CASE WHEN l = 'DELETED' THEN 'deleted' WHEN nw THEN 'added' WHEN c AND d THEN 'content+desc' WHEN c THEN 'content' ELSE 'desc' END AS kind FROM x WHERE NOT (l = 'DELETED' AND nw)""")  # fmt: skip
add("set9_live_and_ghosts", lambda m: hs.live_and_ghosts(m, SINCE),
    f"""SELECT id, false AS ghost FROM n WHERE id IN (SELECT node_id FROM h WHERE scanned_at > {_T} AND change_type IN ('INITIAL', 'CONTENT_ONLY', 'DESC_ONLY', 'CONTENT_AND_DESC'))
    UNION ALL SELECT DISTINCT node_id, true FROM h WHERE scanned_at > {_T} AND change_type = 'DELETED' AND node_id NOT IN (SELECT id FROM n)""")  # fmt: skip
