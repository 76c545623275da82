"""References to records that do not exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import Heavy, blank, cut, salted_join

STATE = ("key", "refs", "existing", "first_ref", "first_seen", "was_deleted")


def reference_deltas(refs: DataFrame, sign: int = 1) -> DataFrame:
    """Changes of the reference count: +1 for each reference that came to be, sign -1 for those taken away.

    refs: key string, ref_time timestamp. Null and blank keys refer to nothing and are left out.
    """
    none = F.lit(None).cast("timestamp")
    return refs.filter(~blank("key")).select("key", F.lit(sign).cast("long").alias("refs"), F.lit(0).cast("long").alias("existing"), F.col("ref_time").alias("first_ref"), none.alias("first_seen"), F.lit(False).alias("was_deleted"))


def existence_deltas(ids: DataFrame, sign: int = 1) -> DataFrame:
    """Changes of the existence count. ids: key string, seen_at timestamp; repeated deliveries of a key count once per call."""
    none = F.lit(None).cast("timestamp")
    once = ids.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("seen_at").alias("first_seen"))
    return once.select("key", F.lit(0).cast("long").alias("refs"), F.lit(sign).cast("long").alias("existing"), none.alias("first_ref"), "first_seen", F.lit(False).alias("was_deleted"))


def deletion_marks(ids: DataFrame) -> DataFrame:
    """Keys known to have been deleted at some time: no change of a count, only the mark. ids: key string."""
    none = F.lit(None).cast("timestamp")
    zero = F.lit(0).cast("long")
    return ids.filter(F.col("key").isNotNull()).select("key", zero.alias("refs"), zero.alias("existing"), none.alias("first_ref"), none.alias("first_seen"), F.lit(True).alias("was_deleted"))


def apply_deltas(state: DataFrame | None, *deltas: DataFrame) -> DataFrame:
    """The state per key after the deltas: signed sums of references and existence, the earliest times and the deletion mark.

    A pure fold: batches may be applied in any order or grouping with the same outcome. Sums are combined before the
    shuffle, so that a key with a third of all rows costs a row per task.
    """
    parts = [d.select(*STATE) for d in (*(x for x in (state,) if x is not None), *deltas)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("key").agg(
        F.sum("refs").alias("refs"), F.sum("existing").alias("existing"), F.min("first_ref").alias("first_ref"), F.min("first_seen").alias("first_seen"), F.max("was_deleted").alias("was_deleted")
    )


def orphan_keys(state: DataFrame) -> DataFrame:
    """The current orphan report: keys with positive references and zero existence."""
    return state.filter((F.col("refs") > 0) & (F.col("existing") <= 0))


def orphan_references(refs: DataFrame, ids: DataFrame, deleted: DataFrame) -> DataFrame:
    """The references whose key is `missing`, `deleted` or, known only from a time after the reference, `late`.

    refs: table_name, ref_field, row_key, key, ref_time (a row per reference). ids: key, seen_at. deleted: key.
    Null and blank keys are no references; keys are compared exactly; a reference without a time is never late;
    further columns are ignored. Empty inputs give an empty result.
    Columns: table_name, ref_field, row_key, key, ref_time, kind.
    """
    refs = refs.select("table_name", "ref_field", "row_key", "key", "ref_time").filter(~blank("key"))
    state = apply_deltas(None, reference_deltas(refs), existence_deltas(ids), deletion_marks(deleted))
    # Only keys that can carry a case go into the join back to the references.
    late = (F.col("existing") > 0) & (F.col("first_seen") > F.col("first_ref"))
    suspects = cut(state.filter((F.col("refs") > 0) & ((F.col("existing") <= 0) | late)))
    heavy = Heavy(suspects, "key", "refs")
    joined = salted_join(refs, suspects.select("key", "existing", "first_seen", "was_deleted"), "key", heavy, F.col("row_key"))
    kind: Column = F.when(F.col("existing") <= 0, F.when(F.col("was_deleted"), "deleted").otherwise("missing")).when(F.col("first_seen") > F.col("ref_time"), "late")
    return joined.withColumn("kind", kind).filter(F.col("kind").isNotNull()).select("table_name", "ref_field", "row_key", "key", "ref_time", "kind")


def by_period(orphans: DataFrame, unit: str = "month") -> DataFrame:
    """Orphan references counted per table, field, kind and period of the reference; those without a time under a null period."""
    return orphans.groupBy("table_name", "ref_field", F.date_trunc(unit, "ref_time").alias("period"), "kind").agg(F.count("*").alias("n"))


def index_references(edges: DataFrame, verification: DataFrame) -> DataFrame:
    """References of the index: both ends of each distinct edge, and the node of each verification.

    An edge delivered more than once counts once, at its earliest loaded_at, with the ends of that delivery.
    """
    once = edges.groupBy("id").agg(F.min(F.struct("loaded_at", "from_id", "to_id")).alias("e"), F.min("loaded_at").alias("ref_time"))
    ends = once.select("id", "ref_time", F.explode(F.array(F.struct(F.lit("from_id").alias("f"), F.col("e.from_id").alias("k")), F.struct(F.lit("to_id").alias("f"), F.col("e.to_id").alias("k")))).alias("x"))
    a = ends.select(F.lit("edges").alias("table_name"), F.col("x.f").alias("ref_field"), F.col("id").alias("row_key"), F.col("x.k").alias("key"), "ref_time")
    v = verification.groupBy("node_id").agg(F.min("verified_at").alias("ref_time"))
    return a.unionByName(v.select(F.lit("node_verification").alias("table_name"), F.lit("node_id").alias("ref_field"), F.col("node_id").alias("row_key"), F.col("node_id").alias("key"), "ref_time"))
