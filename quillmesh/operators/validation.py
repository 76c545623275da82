"""Findings: what is wrong with envelopes, their step markers and the edges between them."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The rules and what they say.
RULES = {
    "A1": "the number of a step is a positive number",
    "A2": "a step has a name and a purpose",
    "A3": "the name of an automatic step, if given, is not blank",
    "B1": "no number is given twice",
    "B2": "the whole numbers run from 1 without a gap",
    "B3": "a number with a fraction stands in a loop",
    "B4": "an automatic step is followed by a call of a function with an envelope",
    "C1": "an envelope has a purpose",
}


def _bare(c: str):
    return F.coalesce(F.trim(c), F.lit("")) == ""


def step_findings(steps: DataFrame) -> DataFrame:
    """function, rule, detail: what rules A1 to A3 and B1 to B3 find.

    steps: function, pos (order in the text), step_num (double, null if it is no number), name, purpose, is_auto, in_loop.
    """
    ok = F.col("step_num").isNotNull() & (F.col("step_num") > 0)
    number = F.col("step_num").cast("string")
    per_step = F.array(
        F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit("A1").alias("rule"), F.coalesce(number, F.lit("none")).alias("detail"))),
        F.when(ok & ~F.col("is_auto") & (_bare("name") | _bare("purpose")), F.struct(F.lit("A2").alias("rule"), number.alias("detail"))),
        F.when(ok & F.col("is_auto") & F.col("name").isNotNull() & _bare("name"), F.struct(F.lit("A3").alias("rule"), number.alias("detail"))),
        F.when((F.col("step_num") % 1 != 0) & ~F.coalesce("in_loop", F.lit(False)), F.struct(F.lit("B3").alias("rule"), number.alias("detail"))),
    )
    single = steps.select("function", F.explode(F.array_compact(per_step)).alias("x")).select("function", "x.*")
    first = Window.partitionBy("function", "step_num").orderBy("pos")
    twice = steps.filter("step_num is not null").withColumn("rn", F.row_number().over(first)).filter("rn > 1").select("function", F.lit("B1").alias("rule"), number.alias("detail"))
    whole = steps.filter(F.floor("step_num") > 0).groupBy("function").agg(F.collect_set(F.floor("step_num").cast("int")).alias("have"))
    gap = F.array_except(F.sequence(F.lit(1), F.array_max("have")), F.col("have"))
    gaps = whole.filter(F.size(gap) > 0).select("function", F.lit("B2").alias("rule"), F.array_join(gap, ",").alias("detail"))
    return single.unionByName(twice).unionByName(gaps)


def envelope_findings(envelopes: DataFrame) -> DataFrame:
    """function, rule, detail of rule C1. envelopes: id, purpose."""
    return envelopes.filter(_bare("purpose")).select(F.col("id").alias("function"), F.lit("C1").alias("rule"), F.lit("").alias("detail"))


def autostep_findings(autosteps: DataFrame, envelope_of: DataFrame) -> DataFrame:
    """function, rule, detail of rule B4. autosteps: step, target (null: no call follows, or of nothing known).

    envelope_of: function (those that an envelope annotates)."""
    told = autosteps.join(envelope_of.select(F.col("function").alias("target"), F.lit(True).alias("has")).distinct(), "target", "left")
    detail = F.when(F.col("target").isNull(), "unresolved").when(F.col("has").isNull(), F.concat(F.lit("undecorated: "), "target"))
    return told.select(F.col("step").alias("function"), F.lit("B4").alias("rule"), detail.alias("detail")).filter("detail is not null")


def enabled(findings: DataFrame, off: Collection[str] = ()) -> DataFrame:
    """Findings without those of the rules that are off; an unknown rule is an error."""
    wrong = sorted(set(off) - set(RULES))
    if wrong:
        raise ValueError(f"unknown rules: {wrong}")
    return findings.filter(~F.col("rule").isin(*off)) if off else findings


def nav_findings(leaves: DataFrame, docs: DataFrame) -> DataFrame:
    """path of the leaves (path, doc_id) of a navigation that name no document (id)."""
    return leaves.join(docs.select(F.col("id").alias("doc_id")), "doc_id", "left_anti").select("path", "doc_id")
