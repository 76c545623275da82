import json

from quillmesh.operators import validation as va
from quillmesh.sources import literals as lit
from quillmesh.sources import scan, scripts
from quillmesh.sources import javascript as js

APP = """// Runs the jobs. More.
import def, { helper as h, other } from './lib/help';
import * as ns from "../shared/net.ts";
import type { T } from './types';
import React from 'react';

/** Loads a row. And more.
 * @param {string} id the id
 */
export function load(id) { function inner() {} return h(id); }
export const save = async (x) => x;
const make = function (a) { return a; };
export class Store {
  /** Puts it. */
  put(a) { if (a) { return 1; } }
  static get size() { return 2; }
}
const api = { read(x) { return x; }, write: (y) => y };
/** Whole run. */
export const run = workflow({ purpose: 'Runs it', inputs: "a", critical: `no` })(async (a) => {
  Step({ step_num: 1, name: 'one', purpose: 'first' });
  AutoStep({ step_num: 2 });
  const r = await h(a);
  for (const q of a) { AutoStep({ step_num: 2.1 }); ns.send(q); }
  Step({ step_num: 4, name: '', purpose: 'x' });
  Step({ step_num: 1, name: 'again', purpose: 'again' });
  AutoStep({ step_num: 5 }); save(r);
  Step({ step_num: 6.5, name: 'n', purpose: 'p' });
});
"""
TEST = """import { run } from '../app';
const local = task({ purpose: 'p' })(() => { Step({ step_num: 1, name: 'a', purpose: 'b' }); });
test('Does It', local);
describe('block', () => { it('runs well', workflow({ purpose: 'w' })(async () => { Step({ step_num: 1, name: 'a', purpose: 'b' }); })); });
test('runs well', workflow({ purpose: 'w' })(() => {}));
test(name, local);
test('plain', () => {});
"""
MACHINE = """import { fetchRow } from './lib/help';
export const flow = setup({ actors: { getRow: fetchRow, own: localOne } }).createMachine({
  id: 'lights', meta: { purpose: 'Turns' }, initial: 'red',
  states: {
    red: { on: { GO: 'green', 'X.Y': { target: '#lights.blue.deep', internal: true }, BAD: nowhere }, after: { 1000: 'green' } },
    green: { always: [{ target: 'red' }, 'blue.deep', fn()], meta: { purpose: 'Go' } },
    blue: { initial: 'deep', states: { deep: { on: { UP: 'flat', OUT: 'red', LOST: 'none' } }, flat: { type: 'final' } }, invoke: { src: 'getRow', onDone: { target: 'green' }, onError: 'nope' } },
    white: { invoke: [{ src: 'own' }] },
    odd: someVariable,
  },
});
const other = createMachine(config);
"""


def all_facts(spark):
    files = [("p/src/app.ts", APP), ("p/src/lib/help.ts", "export function helper() {}\nexport function fetchRow() {}\n"), ("p/shared/net.ts", "export const send = (x) => x;\n"), ("p/tests/app.spec.ts", TEST), ("p/src/flow.js", MACHINE), (None, "x"), ("p/src/none.js", None), ("p/src/empty.js", "")]
    return scripts.script_facts(spark.createDataFrame(files, "location string, content string")).cache()


def test_functions_and_imports(spark):
    f = all_facts(spark)
    nodes = {r.id: r for r in scan.fact_nodes(f).collect()}
    app = "p::src.app"
    mine = {k.removeprefix(app): v.subtype for k, v in nodes.items() if k.startswith(app) and "step-" not in k}
    assert mine == {"": "module", "::load": "function", "::save": "function", "::make": "function", "::Store.put": "function", "::Store.size": "function", "::api.read": "function", "::api.write": "function", "::run": "function", "::run@workflow": "workflow"}
    assert nodes[app].level_1 == "Runs the jobs." and nodes[f"{app}::load"].level_1 == "load -- Loads a row." and nodes[f"{app}::load"].level_2 == "Loads a row. And more."
    assert nodes[f"{app}::run"].level_1 == "run -- Whole run." and nodes[f"{app}::save"].level_1 == "save function" and nodes[f"{app}::load"].level_3_location == "p/src/app.ts#L10-L10"
    assert nodes["p::tests.app.spec"].node_type == "composite_process" and nodes["p::tests.app.spec::local"].subtype == "test" and nodes["p::src.empty"].level_1 == "empty module"
    edges = {(r.edge_type, r.from_id, r.to_id) for r in scan.fact_edges(f).collect()}
    assert {e for e in edges if e[0] == "depends_on" and e[1].startswith("p::src.app")} == {("depends_on", app, "p::src.lib.help"), ("depends_on", app, "p::shared.net")}
    assert ("composes", app, f"{app}::Store.put") in edges and ("annotates", f"{app}::run@workflow", f"{app}::run") in edges
    f.unpersist()


def test_steps_and_rules(spark):
    f = all_facts(spark)
    run = "p::src.app::run"
    nodes = {r.id: r for r in scan.fact_nodes(f).collect()}
    assert sorted(k.removeprefix(run) for k in nodes if k.startswith(run + "::step")) == [f"::step-{x}" for x in ("1", "2", "2.1", "4", "5", "6.5")]
    assert nodes[f"{run}::step-1"].title == "one" and nodes[f"{run}::step-2"].subtype == "autostep" and nodes[f"{run}@workflow"].level_2 == "Runs it"
    edges = {(r.edge_type, r.from_id, r.to_id) for r in scan.fact_edges(f).collect()}
    assert {e[1:] for e in edges if e[0] == "delegates_to" and e[1].startswith(run)} == {(f"{run}::step-2", "p::src.lib.help::helper"), (f"{run}::step-2.1", "p::shared.net::send"), (f"{run}::step-5", "p::src.app::save")}
    got = {(r.rule, r.detail) for r in va.step_findings(scan.fact_steps(f)).filter(f"function = '{run}'").collect()}
    assert got == {("A2", "4.0"), ("B1", "1.0"), ("B2", "3"), ("B3", "6.5")}
    f.unpersist()


def test_runners(spark):
    f = all_facts(spark)
    t = "p::tests.app.spec"
    nodes = {r.id: r for r in scan.fact_nodes(f).collect()}
    assert set(nodes[f"{t}::local@workflow"].tags) == {"task", "envelope", "test"} and json.loads(nodes[f"{t}::local@workflow"].meta)["test_name"] == "Does It"
    inline = nodes[f"{t}::test::runs-well@workflow"]
    assert inline.title == "runs well" and "test" in inline.tags and f"{t}::test::runs-well::step-1" in nodes
    assert {(r.name, r.id.rpartition("::")[2]) for r in f.filter(f"kind = 'finding' and startswith(id, '{t}')").collect()} == {("D1", "test('runs well')"), ("D2", "test(...)")}
    f.unpersist()


def test_machines(spark):
    f = all_facts(spark)
    m = "p::src.flow::lights@machine"
    nodes = {r.id: r for r in scan.fact_nodes(f).collect()}
    states = {k.removeprefix(f"{m}.states."): v.node_type for k, v in nodes.items() if k.startswith(f"{m}.states.")}
    assert states == {"red": "atomic_process", "green": "atomic_process", "blue": "composite_process", "blue.deep": "atomic_process", "blue.flat": "atomic_process", "white": "atomic_process"}
    assert nodes[m].level_2 == "Turns" and "final" in nodes[f"{m}.states.blue.flat"].tags and nodes[f"{m}.states.green"].level_2 == "Go"
    s = lambda x: f"{m}.states.{x}"
    moves = {(r.from_id.removeprefix(f"{m}.states."), r.to_id.removeprefix(f"{m}.states."), json.loads(r.meta).get("via")) for r in scan.fact_edges(f).filter(f"edge_type = 'delegates_to' and startswith(from_id, '{m}')").collect()}
    assert moves >= {("green", "red", "always"), ("green", "blue.deep", "always"), ("red", "blue.deep", "on"), ("blue.deep", "blue.flat", "on"), ("blue.deep", "red", "on"), ("blue", "green", "invoke.onDone"), ("blue", "p::src.lib.help::fetchRow", "invoke"), ("white", "p::src.flow::localOne", "invoke")}
    assert any(a == "red" and b == "green" for a, b, _ in moves) and {b for a, b, v in moves if b.endswith("<unresolved>")} == {f"{m}.<unresolved>"}
    composed = {(r.from_id, r.to_id) for r in scan.fact_edges(f).filter("edge_type = 'composes'").collect()}
    assert (m, s("blue")) in composed and (s("blue"), s("blue.deep")) in composed and ("p::src.flow", m) in composed
    assert f.filter("kind = 'finding' and name = 'X1'").count() == 4  # nowhere, fn(), someVariable, config
    f.unpersist()


def test_state_targets():
    paths, top = {"a", "b", "b.c", "b.a"}, {"a", "b"}
    t = scripts.state_target
    assert t("#m.b.c", "", top, paths, "m") == "b.c" and t("#b.c", "", top, paths, "m") == "b.c" and t("#m.x", "", top, paths, "m") is None
    assert t("a", "b", {"c", "a"}, paths, "m") == "b.a" and t("b.c", "a", set(), paths, "m") == "b.c" and t("c", "b", set(), paths, "m") == "b.c" and t("", "", top, paths, "m") is None


def test_literals():
    text = "x({ a: 'it\\'s', \"b c\": [1, -2.5, true, null, n.m], d: f(1, {z: 2}), /* c */ e: `t`, g, h() { return 1; }, ...rest, [k]: 3, i: { j: {} } })"
    v = lit.parse(text, js.mask(text)[0], 2).value
    assert lit.plain(v) == {"a": "it's", "b c": [1, -2.5, True, None, "n.m"], "d": "f(1, {z: 2})", "e": "t", "g": "g", "h": "h() { return 1; }", "i": {"j": {}}}


def test_docstring_parts():
    doc = "Sums.\n\nArgs:\n    a (int): first\n        and more\n    *b: rest\n\nReturns:\n    int: the sum\n\nRaises:\n    ValueError: if bad\n\nEnd."
    assert scan.docstring_parts(doc) == {"params": [{"name": "a", "type": "int", "desc": "first and more"}, {"name": "b", "desc": "rest"}], "returns": [{"type": "int", "desc": "the sum"}], "raises_doc": [{"type": "ValueError", "desc": "if bad"}]}
    assert scan.docstring_parts("x\n:param int a: one\n:type b: str\n:param b: two\n:returns: r\n:rtype: list\n:raises KeyError: k") == {"params": [{"name": "a", "type": "int", "desc": "one"}, {"name": "b", "desc": "two", "type": "str"}], "returns": [{"desc": "r", "type": "list"}], "raises_doc": [{"type": "KeyError", "desc": "k"}]}
    assert scan.docstring_parts("") == {}
