"""Foreign-key discovery by value overlap and by name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import HIGH_CONFIDENCE_BPS
from ..functions.scalars import as_text, bps
from ..session import measured
from .profiling import first_rows

TILE = 2048  # rows of each side that meet under one join key
PAIR_ROWS = 8_000_000  # of a result that outgrows its input, in one partition


def relationship_overlap(src: DataFrame, src_col: str, dst: DataFrame, dst_col: str, n: int | None = None,
                         src_order: list[str] | None = None, dst_order: list[str] | None = None) -> DataFrame:
    """J1 (bounded to the first ``n`` rows) and J2 (whole tables): counts of both sides and of shared values.

    Each side is combined to (value, n) first, so a hot value is one row before the join.
    """
    a = first_rows(src, n, src_order) if n else src
    b = first_rows(dst, n, dst_order) if n else dst
    sv = a.select(F.col(src_col).alias("v")).filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("sn"))
    dv = b.select(F.col(dst_col).alias("v")).filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("dn"))
    zero = F.lit(0).cast("long")
    return sv.join(dv, "v", "full_outer").agg(
        F.coalesce(F.sum("sn"), zero).alias("source_non_null_count"),
        F.count("sn").alias("source_distinct_count"),
        F.coalesce(F.sum("dn"), zero).alias("target_non_null_count"),
        F.count("dn").alias("target_distinct_count"),
        F.count_if(F.col("sn").isNotNull() & F.col("dn").isNotNull()).alias("matched_distinct_count"))


def column_values(tables: dict[str, DataFrame], columns: list[tuple[str, str]]) -> DataFrame:
    """(column_id, value_key, n) of several columns of several tables; column_id is table.column."""
    def one(t, x):
        df = tables[t]
        return df.select(F.lit(f"{t}.{x}").alias("column_id"), as_text(x, df.schema[x].dataType).alias("value_key")).filter("value_key is not null")
    return reduce(DataFrame.unionByName, [one(t, x) for t, x in columns]).groupBy("column_id", "value_key").agg(F.count(F.lit(1)).alias("n"))


def overlap_all_pairs(values: DataFrame, pairs: DataFrame) -> DataFrame:
    """J2 over many pairs in one job: ``pairs`` (source_id, target_id), metadata-sized.

    Each source value is sent only to the targets it is paired with and meets the target's distinct values on
    (target_id, value_key), a key that never holds more rows than there are source columns. Pairs with no shared
    value keep their zero row (negative evidence).
    """
    per_col = values.groupBy("column_id").agg(F.sum("n").alias("nn"), F.count(F.lit(1)).alias("nd"))
    src = values.select(F.col("column_id").alias("source_id"), "value_key").join(pairs, ["source_id"])
    dst = values.select(F.col("column_id").alias("target_id"), "value_key")
    hit = src.join(dst, ["target_id", "value_key"], "left_semi").groupBy("source_id", "target_id").agg(F.count(F.lit(1)).alias("m"))
    zero = F.lit(0).cast("long")
    return (
        pairs.join(hit, ["source_id", "target_id"], "left")
        .join(per_col.select(F.col("column_id").alias("source_id"), F.col("nn").alias("sn"), F.col("nd").alias("sd")), "source_id", "left")
        .join(per_col.select(F.col("column_id").alias("target_id"), F.col("nn").alias("tn"), F.col("nd").alias("td")), "target_id", "left")
        .select("source_id", "target_id",
                F.coalesce("sn", zero).alias("source_non_null_count"), F.coalesce("sd", zero).alias("source_distinct_count"),
                F.coalesce("tn", zero).alias("target_non_null_count"), F.coalesce("td", zero).alias("target_distinct_count"),
                F.coalesce("m", zero).alias("matched_distinct_count"))
    )


def overlap_violations(o: DataFrame) -> DataFrame:
    """Counts that cannot be true of an overlap."""
    return o.filter("source_distinct_count > source_non_null_count or target_distinct_count > target_non_null_count "
                    "or matched_distinct_count > source_distinct_count or matched_distinct_count > target_distinct_count")


def overlap_metrics(o: DataFrame, min_bps: int = 9000) -> DataFrame:
    """J3. Overlap and coverage rates, confidence, strict link eligibility and counterevidence."""
    sd, td, tn, m = (F.col(x) for x in ("source_distinct_count", "target_distinct_count", "target_non_null_count", "matched_distinct_count"))
    out = (
        o.withColumn("overlap_bps", bps("matched_distinct_count", "source_distinct_count"))
        .withColumn("target_coverage_bps", bps("matched_distinct_count", "target_distinct_count"))
        .withColumn("target_duplicate_count", tn - td).withColumn("unmatched_distinct_count", sd - m)
    )
    eligible = (sd > 0) & (F.col("overlap_bps") >= min_bps)
    dup, un = F.col("target_duplicate_count"), F.col("unmatched_distinct_count")

    def item(code, n):
        return F.struct(F.lit(code).alias("reason_code"), n.cast("long").alias("count"))

    return (
        out.withColumn("eligible", eligible)
        .withColumn("confidence", F.when(~eligible, "LOW").when(F.col("overlap_bps") >= HIGH_CONFIDENCE_BPS, "HIGH").otherwise("MEDIUM"))
        .withColumn("link_eligible", (sd > 0) & (dup == 0) & (un == 0))
        .withColumn("status", relationship_status(F.col("link_eligible")))
        .withColumn("counterevidence", F.array_compact(F.array(
            F.when(dup > 0, item("TARGET_NOT_UNIQUE", dup)), F.when(un > 0, item("SOURCE_VALUES_UNMATCHED", un)),
            F.when(sd == 0, item("SOURCE_HAS_NO_DISTINCT_VALUES", F.lit(0))))))
    )


def relationship_status(inferred: Column) -> Column:
    """G7. A link that was inferred is a proposal; anything else is counterevidence only."""
    return F.when(inferred, "PROPOSAL_ONLY").otherwise("COUNTEREVIDENCE_ONLY")


SKETCH = 256  # least value hashes that a column's sketch holds


def value_sketches(values: DataFrame, id_cols: list[str] = ("column_id",), k: int = SKETCH) -> DataFrame:
    """id_cols, lo, hi, n_distinct, hashes, whole: one row per column of distinct values (id_cols, value_key).

    lo and hi by text order, hashes the ``k`` least 64-bit value hashes, whole if these are all. Ranges and hashes of parts
    of a column merge (least, greatest, the k least of both); only k hashes per task and column are shuffled.
    """
    ids = list(id_cols)
    v = values.select(*ids, "value_key", F.xxhash64("value_key").alias("_h"))
    wide = v.groupBy(*ids).agg(F.min("value_key").alias("lo"), F.max("value_key").alias("hi"), F.count(F.lit(1)).alias("n_distinct"))
    least = v.select(*ids, "_h", F.row_number().over(Window.partitionBy(*ids).orderBy("_h")).alias("_n")).where(F.col("_n") <= k)
    bottom = least.groupBy(*ids).agg(F.sort_array(F.collect_list("_h")).alias("hashes"))
    return wide.join(bottom, ids).withColumn("whole", F.col("n_distinct") <= k)


def inclusion_refuted(src: str = "s", dst: str = "d") -> Column:
    """Why not all values of src can be in dst, from sketches in struct columns; null if that stays possible.

    Each reason is a proof: a least or greatest value outside the other's range, more distinct values than the other has, or a
    hash of src that dst's sketch would hold if dst had the value.
    """
    s, d = (lambda x: F.col(f"{src}.{x}")), (lambda x: F.col(f"{dst}.{x}"))
    limit = F.element_at(d("hashes"), -1)
    known = F.filter(s("hashes"), lambda h: d("whole") | (h <= limit))
    return (F.when((s("lo") < d("lo")) | (s("hi") > d("hi")), "OUT_OF_RANGE").when(s("n_distinct") > d("n_distinct"), "MORE_DISTINCT_VALUES")
            .when(F.size(F.array_except(known, d("hashes"))) > 0, "VALUE_MISSING"))


def refute_pairs(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """J4. pairs (source_id, target_id) with refuted_by, from sketches (column_id, ...). A column without values is included
    anywhere, and includes only such a column (NO_VALUES)."""
    body = F.struct("lo", "hi", "n_distinct", "hashes", "whole")
    s = sketches.select(F.col("column_id").alias("source_id"), body.alias("s"))
    d = sketches.select(F.col("column_id").alias("target_id"), body.alias("d"))
    j = pairs.join(s, "source_id", "left").join(d, "target_id", "left")
    why = F.when(F.col("s").isNull(), F.lit(None).cast("string")).when(F.col("d").isNull(), "NO_VALUES").otherwise(inclusion_refuted())
    return j.withColumn("refuted_by", why).drop("s", "d")


def inclusions(values: DataFrame, pairs: DataFrame, k: int = SKETCH) -> DataFrame:
    """J4 with J2. pairs with refuted_by and included: only pairs that no sketch refutes have their values compared."""
    judged = refute_pairs(pairs, value_sketches(values, k=k))
    left = judged.where("refuted_by is null").select("source_id", "target_id")
    full = overlap_all_pairs(values, left).select("source_id", "target_id", (F.col("matched_distinct_count") == F.col("source_distinct_count")).alias("_all"))
    return judged.join(full, ["source_id", "target_id"], "left").withColumn("included", F.coalesce("_all", F.lit(False))).drop("_all")


def candidate_pairs(profiled: DataFrame, constraints: DataFrame, keys: list[str] = ()) -> DataFrame:
    """J4. Profiled columns against single-column PK / UNIQUE targets of the same name and native type.

    profiled: schema_name, relation_name, column_name, native_type. constraints: one row per constraint column.
    Both ends must be profiled; a column is not paired with itself; declared foreign keys are left out.
    ``keys`` (such as source_id) tell databases apart: only columns of one database are paired.
    """
    cols = ["schema_name", "relation_name", "column_name"]
    single = (
        constraints.filter(F.col("constraint_kind").isin("PRIMARY_KEY", "UNIQUE"))
        .groupBy(*keys, "schema_name", "relation_name", "constraint_name", "constraint_kind")
        .agg(F.count(F.lit(1)).alias("n"), F.max("column_name").alias("column_name")).filter("n = 1 and column_name is not null").drop("n")
    )
    tgt = single.join(profiled, [*keys, *cols]).select(
        *keys, *[F.col(x).alias("target_" + x) for x in cols if x != "column_name"], "column_name", "native_type", "constraint_kind", "constraint_name")
    src = profiled.select(*keys, F.col("schema_name").alias("source_schema_name"), F.col("relation_name").alias("source_relation_name"), "column_name", "native_type")
    fk = constraints.filter("constraint_kind = 'FOREIGN_KEY'").select(*keys,
        F.col("schema_name").alias("source_schema_name"), F.col("relation_name").alias("source_relation_name"), "column_name",
        F.col("referenced_schema_name").alias("target_schema_name"), F.col("referenced_relation_name").alias("target_relation_name"),
        F.col("referenced_column_name").alias("_ref")).filter(F.col("_ref") == F.col("column_name")).drop("_ref")
    # a column's own declared targets travel with it, so that no pair is shuffled to be compared with them
    ends = ["target_schema_name", "target_relation_name"]
    own = [*keys, "source_schema_name", "source_relation_name", "column_name"]
    declared = fk.dropna(subset=ends).groupBy(*own).agg(F.collect_set(F.struct(*ends)).alias("_declared"))
    pairs = _tiled(src.join(declared, own, "left"), tgt, [*keys, "column_name", "native_type"], own[-3:-1], ends).filter(
        (F.col("source_schema_name") != F.col("target_schema_name")) | (F.col("source_relation_name") != F.col("target_relation_name")))
    return pairs.filter(F.col("_declared").isNull() | ~F.array_contains("_declared", F.struct(*ends))).select(
        *own[:-1], *ends, "column_name", "native_type", "constraint_kind", "constraint_name")


def _tiled(left: DataFrame, right: DataFrame, on: list[str], left_ids: list[str], right_ids: list[str]) -> DataFrame:
    """Equi-join whose result may be the square of its input: the rows of a key meet in tiles of some ``TILE`` by ``TILE`` rows,
    dealt to one partition for every ``PAIR_ROWS`` of the result. Bytes of the input say nothing about that, so pairs are counted first.
    The ids (columns of one side) deal the rows of a key to its tiles.
    """
    left, right = measured(left), measured(right)
    met = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_a")).join(right.groupBy(*on).agg(F.count(F.lit(1)).alias("_b")), on)
    met = measured(met)
    total = met.agg(F.sum(F.col("_a").cast("decimal(38,0)") * F.col("_b"))).first()[0] or 1
    tiles = met.select(*on, F.ceil(F.col("_a") / TILE).alias("_n"), F.ceil(F.col("_b") / TILE).alias("_m"))

    def side(df, ids, mine, own, other, across):
        dealt = df.join(tiles, on).withColumn(mine, F.pmod(F.xxhash64(*ids), F.col(own)))
        dealt = dealt.withColumn(across, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))).drop("_n", "_m")
        return dealt.repartition(-(-int(total) // PAIR_ROWS), *on, "_i", "_j")

    return side(left, left_ids, "_i", "_n", "_m", "_j").join(side(right, right_ids, "_j", "_m", "_n", "_i"), [*on, "_i", "_j"]).drop("_i", "_j")


def _stem(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "ies$", "y"), "s$", "")


def inferred_links(columns: DataFrame, declared: DataFrame) -> DataFrame:
    """J5. ``x_id`` whose stem equals, or ends, the stem of another table that has a key.

    columns: scope (the database), table_name, column_name, is_key. Every suffix of a table stem becomes a join
    key, so the 'ends with' rule is an equi-join instead of a nested loop; a name has a bounded number of suffixes.
    """
    left = columns.filter(F.lower("column_name").endswith("_id")).select(
        "scope", F.col("table_name").alias("from_table"), F.col("column_name").alias("from_column"),
        _stem(F.regexp_replace(F.lower("column_name"), "_id$", "")).alias("stem"))
    keyed = (
        columns.groupBy("scope", "table_name").agg(F.bool_or(F.col("is_key") | (F.lower("column_name") == "id")).alias("k")).filter("k")
        .select("scope", F.col("table_name").alias("to_table"), _stem(F.col("table_name")).alias("s"))
    )
    suffixes = keyed.select("scope", "to_table", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("s") + 1), lambda i: F.expr("s").substr(i, F.length("s")))).alias("stem"))
    hit = left.join(suffixes, ["scope", "stem"]).filter("from_table <> to_table").select(
        F.lit("inferred_key_name").alias("kind"), "scope", "from_table", "from_column", "to_table", F.lit("id").alias("to_column"),
        F.lit(0.65).alias("confidence"), F.concat(F.lit("name-pattern:"), "from_column").alias("evidence"))
    known = declared.select("scope", "from_table", "from_column", "to_table", "to_column")
    return hit.join(known, ["scope", "from_table", "from_column", "to_table", "to_column"], "left_anti")


def declared_links(constraints: DataFrame, id_col: Column | None = None) -> DataFrame:
    """J6. Foreign keys as edges of confidence 1."""
    return constraints.filter("constraint_kind = 'FOREIGN_KEY'").select(
        F.lit("declared_foreign_key").alias("kind"), F.col("schema_name").alias("scope"), F.col("relation_name").alias("from_table"),
        F.col("column_name").alias("from_column"), F.col("referenced_relation_name").alias("to_table"),
        F.col("referenced_column_name").alias("to_column"), F.lit(1.0).alias("confidence"),
        F.concat(F.lit("pragma:"), "relation_name", F.lit(":"), id_col if id_col is not None else F.col("constraint_name")).alias("evidence"))


def orphan_values(child: DataFrame, child_col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    """J7. Child values with no parent and how many rows hold each; values are combined before the join."""
    kids = child.select(F.col(child_col).alias("v")).filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("row_count"))
    return kids.join(parent.select(F.col(parent_col).alias("v")).filter("v is not null"), "v", "left_anti").withColumnRenamed("v", "orphan_value")


def orphan_probe(child: DataFrame, child_col: str, parent: DataFrame, parent_col: str, relationship: str) -> DataFrame:
    """J7. The verdict row of a link test."""
    return orphan_values(child, child_col, parent, parent_col).agg(
        F.coalesce(F.sum("row_count"), F.lit(0)).cast("long").alias("orphan_rows"), F.count(F.lit(1)).alias("orphan_values")).select(
        F.lit("orphan_probe").alias("test"), F.lit(relationship).alias("relationship"), (F.col("orphan_rows") == 0).alias("passed"),
        "orphan_rows", "orphan_values")


def target_coverage(targets: DataFrame, coverage: DataFrame) -> DataFrame:
    """J20. Coverage of the endpoints of each target: one row expected for a column, two for a relationship.

    targets: target_id plus the fields of contracts.TARGET. coverage: schema_name, relation_name, column_name, state.
    """
    ends = F.array_compact(F.array(
        F.struct(F.col("schema_name").alias("s"), F.col("relation_name").alias("r"), F.col("column_name").alias("k")),
        F.when(F.col("kind") == "RELATIONSHIP", F.struct(F.col("dst_schema_name").alias("s"), F.col("dst_relation_name").alias("r"), F.col("dst_column_name").alias("k")))))
    e = targets.select("target_id", "kind", F.explode(ends).alias("e")).select(
        "target_id", "kind", F.col("e.s").alias("schema_name"), F.col("e.r").alias("relation_name"), F.col("e.k").alias("column_name"))
    cov = coverage.select("schema_name", "relation_name", "column_name", "state")
    j = e.join(cov, ["schema_name", "relation_name", "column_name"], "left").groupBy("target_id", "kind").agg(
        F.count("state").alias("covered"), F.count_if(F.col("state") == "COMPLETE").alias("complete"))
    need = F.when(F.col("kind") == "RELATIONSHIP", 2).otherwise(1)
    return j.withColumn("visible", F.col("covered") == need).withColumn(
        "verdict", F.when(F.col("covered") != need, "TARGET_NOT_VISIBLE").when(F.col("complete") < need, "TARGET_COVERAGE_DENIED").otherwise("ALLOWED"))
