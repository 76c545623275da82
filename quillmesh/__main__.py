"""python -m quillmesh PROJECT COMMAND ...: the commands of an index from the shell."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime

from pyspark.sql import DataFrame

from .api import Index
from .runtime import session

SHOWN = 1000


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillmesh")
    p.add_argument("project")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args: tuple, **opts) -> None:
        s = sub.add_parser(name, **opts)
        for names, kw in args:
            s.add_argument(*names, **kw)

    arg = lambda *n, **kw: (n, kw)
    add("init")
    add("build", arg("--sha"), arg("--full", action="store_true"))
    add("check", arg("--fail-on", default="none", choices=["none", "stale", "unverified", "any"]), arg("--json", action="store_true"))
    add("checkout", arg("target"), arg("--force", action="store_true"))
    add("mark-clean", arg("ids", nargs="+"), arg("--reason", default=""), arg("--by", default="human"))
    add("purge", arg("ids", nargs="+"))
    add("link", arg("from_id"), arg("edge_type"), arg("to_id"))
    add("rename-apply", arg("old_id"), arg("new_id"))
    add("rename-revert", arg("new_id"))
    add("list", arg("--type"), arg("--tag"), arg("--parent"), arg("--location"))
    add("graph", arg("node_id"), arg("--direction", default="out"), arg("--depth", type=int, default=1))
    add("search", arg("query"), arg("--type"), arg("--scope", default="all"), arg("--tag"), arg("--most", type=int, default=20))
    add("sql", arg("query"))
    add("drift", arg("--filter"), arg("--glob"), arg("--group-by"), arg("--form"), arg("--page", type=int, default=0))
    add("history", arg("node_id"), arg("--most", type=int, default=10))
    add("checkpoint", arg("sha"), arg("--message", default=""))
    add("agent-verified")
    add("report", arg("--since-sha"), arg("--since"))
    add("render", arg("--level", type=int, default=1), arg("--id"), arg("--offset", type=int, default=0))
    add("read-doc", arg("doc_id"), arg("--section"))
    add("export", arg("target"))
    add("render-site", arg("--only"))
    add("workflows", arg("--role"), arg("--scope", default="production"))
    add("workflow", arg("key"))
    return p


def _show(df: DataFrame) -> int:
    """A page of rows as JSON lines."""
    for r in df.limit(SHOWN).toJSON().collect():
        print(r)
    return 0


def run(argv: list[str], index: Index | None = None) -> int:
    a = _parser().parse_args(argv)
    x = index or Index(session("quillmesh"), a.project)
    match a.command:
        case "init":
            from . import store

            store.save(x.mesh, x.path)
        case "build":
            print(json.dumps(x.build(not a.full, a.sha)))
        case "check":
            counts, code = x.check(a.fail_on)
            print(json.dumps(counts) if a.json else "\n".join(f"{k:28}{v:>10}" for k, v in counts.items()))
            return code
        case "checkout":
            done = x.checkout(a.target, a.force)
            print("copied" if done else "there is an index already; --force replaces it")
            return int(not done)
        case "mark-clean":
            return _show(x.mark_clean(a.ids, a.reason, a.by))
        case "purge":
            return _show(x.purge(a.ids))
        case "link":
            result = x.link(a.from_id, a.edge_type, a.to_id)
            print(result)
            return int(result != "added")
        case "rename-apply":
            return _show(x.apply_rename(a.old_id, a.new_id))
        case "rename-revert":
            return _show(x.revert_rename(a.new_id))
        case "list":
            return _show(x.list(a.type, a.tag, a.parent, a.location).select("id", "node_type", "title", "level_3_location").orderBy("id"))
        case "graph":
            print("\n".join([a.node_id, *x.tree(a.node_id, a.direction, a.depth, 1000)]))
        case "search":
            return _show(x.search(a.query, "keyword", a.most, a.type, a.scope, a.tag))
        case "sql":
            return _show(x.sql(a.query))
        case "drift":
            return _show(x.drift(a.filter, a.glob, a.group_by, a.form, a.page))
        case "history":
            return _show(x.history(a.node_id, a.most))
        case "checkpoint":
            x.checkpoint(a.sha, a.message)
        case "agent-verified":
            return _show(x.agent_verified())
        case "report":
            return _show(x.report(a.since_sha, datetime.fromisoformat(a.since) if a.since else None))
        case "render":
            header, rows = x.render(a.level, a.id, None, 60, a.offset)
            print("\n".join([header, *(r["text"] for r in rows.orderBy("id").collect())]))  # a page
        case "read-doc":
            return _show(x.read_doc(a.doc_id, a.section))
        case "export":
            x.export().write.mode("overwrite").json(a.target)
        case "render-site":
            for name, df in x.render_site(a.only).items():
                print(name, json.dumps({r["state"]: r["count"] for r in df.groupBy("state").count().collect()}))
        case "workflows":
            return _show(x.workflow_list(None, a.role, a.scope))
        case "workflow":
            return _show(x.workflow_detail(a.key))
    return 0


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
