"""Workflow envelopes, their steps and details, and the fixtures of tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..mesh import Mesh
from .graph import expanded_steps
from .inventory import envelopes

ENVELOPES = ("workflow", "task", "state_machine")
STEPS = ("step", "autostep")


def step_number(step_id: Column | str) -> Column:
    """The dotted number at the end of a step's id; empty where there is none."""
    return F.regexp_extract(step_id if isinstance(step_id, Column) else F.col(step_id), r"::step-([0-9.]+)$", 1)


def level_steps(nodes: DataFrame) -> DataFrame:
    """id, pos, step_num and the texts of each step that a node's text marks, in the order of the numbers (null ones first)."""
    ordered = F.array_sort("level_steps", lambda a, b: F.when(F.coalesce(a["step_num"], F.lit(0.0)) < F.coalesce(b["step_num"], F.lit(0.0)), -1).when(F.coalesce(a["step_num"], F.lit(0.0)) > F.coalesce(b["step_num"], F.lit(0.0)), 1).otherwise(0))
    return nodes.filter("level_steps is not null").select("id", F.posexplode(ordered).alias("pos", "s")).select("id", "pos", "s.*")


def steps_of(m: Mesh) -> DataFrame:
    """env, step, subtype of the step nodes that envelopes are composed of."""
    kinds = m.nodes.filter(F.col("subtype").isin(*STEPS)).select(F.col("id").alias("step"), "subtype", "level_1", "level_2", "level_3_location")
    return m.edges.filter("edge_type = 'composes'").select(F.col("from_id").alias("env"), F.col("to_id").alias("step")).join(kinds, "step")


def ordered_steps(m: Mesh) -> DataFrame:
    """env, step, place: steps by their number read as a decimal (1.10 is 1.1), at equal numbers by id; no number counts as 0."""
    number = F.coalesce(step_number("step").try_cast("double"), F.lit(0.0))
    w = Window.partitionBy("env").orderBy("number", "step")
    return steps_of(m).withColumn("number", number).select("env", "step", F.row_number().over(w).alias("place"))


def step_rows(m: Mesh) -> DataFrame:
    """Steps with what they delegate to: env, step, step_number, name, purpose, is_auto, line, target, target_name,
    target_location, target_line. Of several targets the first by id counts; one that no node has keeps its id alone."""
    to = m.edges.filter("edge_type = 'delegates_to'").groupBy(F.col("from_id").alias("step")).agg(F.min("to_id").alias("target"))
    known = m.nodes.select(F.col("id").alias("target"), F.col("location").alias("target_location"), fn.level3("level_3_location").getField("line_start").alias("target_line"), fn.short_name("id").alias("target_name"))
    rows = steps_of(m).join(to, "step", "left").join(known, "target", "left")
    return rows.select("env", "step", step_number("step").alias("step_number"), F.col("level_1").alias("name"), F.col("level_2").alias("purpose"), (F.col("subtype") == "autostep").alias("is_auto"), fn.level3("level_3_location").getField("line_start").alias("line"), "target", "target_name", "target_location", "target_line")


def envelope_items(m: Mesh, subtype: str | None = None, tag: str | None = "envelope") -> DataFrame:
    """Envelopes of one kind (None: each) that carry the tag (None: any), by location: id, subtype, module_name, location,
    line, step_count, function (the node they annotate, the first by id)."""
    out = m.nodes.filter(F.col("node_type") == "composite_process").filter(F.col("subtype").isin(*ENVELOPES) if subtype is None else F.col("subtype") == subtype)
    if tag is not None:
        out = out.join(m.tags.filter(F.col("tag") == tag).select(F.col("node_id").alias("id")).distinct(), "id", "left_semi")
    count = envelopes(m).select("id", "step_count")
    ann = m.edges.filter("edge_type = 'annotates'").groupBy(F.col("from_id").alias("id")).agg(F.min("to_id").alias("function"))
    out = out.join(count, "id", "left").join(ann, "id", "left").orderBy("location", "level_3_location", "id")
    return out.select("id", "subtype", F.get(F.split("id", "::"), 1).alias("module_name"), "location", F.coalesce(fn.level3("level_3_location").getField("line_start"), F.lit(1)).alias("line"), F.coalesce("step_count", F.lit(0)).alias("step_count"), "function")


def resolve_envelopes(m: Mesh, keys: DataFrame) -> DataFrame:
    """key, envelope, how: the envelope that each key names, as its id (`id`), as the function it annotates (`function`) or
    by its short name (`name`); at each stage the first by id. A key that names none has a null envelope."""
    env = m.nodes.filter((F.col("node_type") == "composite_process") & F.col("subtype").isin(*ENVELOPES)).select("id")
    by_id = env.select(F.col("id").alias("key"), F.col("id").alias("envelope"), F.lit(1).alias("how"))
    of = m.edges.filter("edge_type = 'annotates'").join(m.nodes.select(F.col("id").alias("from_id")), "from_id", "left_semi")
    by_function = of.groupBy(F.col("to_id").alias("key")).agg(F.min("from_id").alias("envelope")).withColumn("how", F.lit(2))
    by_name = env.groupBy(fn.short_name("id").alias("key")).agg(F.min("id").alias("envelope")).withColumn("how", F.lit(3))
    best = by_id.unionByName(by_function).unionByName(by_name).groupBy("key").agg(F.min(F.struct("how", "envelope")).alias("x"))
    how = F.element_at(F.array(F.lit("id"), F.lit("function"), F.lit("name")), F.col("x.how"))
    return keys.select("key").distinct().join(best, "key", "left").select("key", F.col("x.envelope").alias("envelope"), F.when(F.col("x").isNotNull(), how).alias("how"))


def workflow_details(m: Mesh) -> DataFrame:
    """The expanded steps of every workflow with what each step says: root, path, step, name, purpose, is_auto, delegates_to,
    note (why the expansion ends there: a cycle, or a target without an envelope)."""
    what = m.nodes.filter(F.col("subtype").isin(*STEPS)).select(F.col("id").alias("step"), "subtype", F.col("level_1").alias("name"), F.coalesce("level_2", F.lit("")).alias("purpose"))
    rows = expanded_steps(m).join(what, "step")
    note = F.when(F.col("cyclic"), F.concat(F.lit("cycle detected at "), "inner")).when((F.col("subtype") == "autostep") & F.col("target").isNotNull() & F.col("inner").isNull(), "target not annotated")
    return rows.select("root", "path", "step", "name", "purpose", (F.col("subtype") == "autostep").alias("is_auto"), F.col("target").alias("delegates_to"), note.alias("note"))


def machine_states(m: Mesh) -> DataFrame:
    """The states of each state machine: machine, state, path, is_compound, is_terminal (tagged final), transitions (their
    number, and as event>target by event and target)."""
    state = m.nodes.filter("subtype = 'state'").withColumn("machine", F.regexp_extract("id", r"^(.*@machine)\.states\.", 1)).filter("machine <> ''")
    out = m.edges.filter("edge_type = 'delegates_to' and via is not null")
    moves = out.groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list(F.concat(F.coalesce("event", F.lit("")), F.lit(">"), "to_id"))), "|").alias("moves"))
    final = m.tags.filter("tag = 'final'").select(F.col("node_id").alias("id"), F.lit(True).alias("final")).distinct()
    rows = state.join(moves, "id", "left").join(final, "id", "left")
    return rows.select("machine", F.col("id").alias("state"), F.expr("substr(id, length(machine) + 9)").alias("path"), (F.col("node_type") == "composite_process").alias("is_compound"), F.coalesce("final", F.lit(False)).alias("is_terminal"), F.coalesce("n", F.lit(0)).alias("n_transitions"), F.coalesce("moves", F.lit("")).alias("transitions"))


# Parameters of tests that are no fixtures of the project.
BUILTIN_FIXTURES = ("self", "request", "tmp_path", "tmp_path_factory", "monkeypatch", "capsys", "capfd", "caplog", "pytestconfig", "recwarn")


def fixture_names(signature: Column | str) -> Column:
    """The parameters named in a signature, without their types and defaults and without those a test runner brings along."""
    c = signature if isinstance(signature, Column) else F.col(signature)
    inside = F.regexp_extract(F.coalesce(c, F.lit("")), r"\(([^)]*)\)", 1)
    names = F.transform(F.split(inside, ","), lambda x: F.trim(F.regexp_extract(x, r"^([^:=]*)", 1)))
    return F.filter(names, lambda x: (x != "") & ~x.isin(*BUILTIN_FIXTURES))


def test_stem(classname: Column | str) -> Column:
    """The last part of a dotted class name that begins with test_, or else its last part."""
    parts = F.split(classname if isinstance(classname, Column) else F.col(classname), r"\.")
    return F.coalesce(F.try_element_at(F.filter(parts, lambda x: x.startswith("test_")), F.lit(-1)), F.element_at(parts, -1))


def test_fixtures(m: Mesh) -> DataFrame:
    """test, fixture: the fixtures (nodes tagged test:fixture) that a test's parameters name by their short name; of several of
    one name the first by id."""
    tagged = m.tags.filter("tag = 'test:fixture'").select(F.col("node_id").alias("id"))
    by_name = m.nodes.select("id").join(tagged, "id", "left_semi").groupBy(fn.short_name("id").alias("name")).agg(F.min("id").alias("fixture"))
    wanted = m.nodes.filter("subtype = 'test'").select(F.col("id").alias("test"), F.explode(F.array_distinct(fixture_names("level_1"))).alias("name"))
    return wanted.join(by_name, "name").select("test", "fixture")
