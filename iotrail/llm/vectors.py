"""Operator 5: near-duplicate vectors by an exact metric range join under the angle, within each label.

Equal vectors of a label are one class with a count; only classes are compared. Labels of more than a cell's worth of
classes get pivots, the classes of lowest hash. A class belongs to the cell of its nearest pivot and is copied to each
other cell whose pivot is within its own nearest distance plus twice the range: by the triangle inequality no cell
can then miss a partner of its members. No more than `fanout` pivots divide a cell; cells that are still too large
are divided again by pivots of their own (copies are treated alike, so the inequality holds at each level), until
they are small or a level does not halve them. Each cell and its pivots meet in tasks of bounded size, so neither the
driver nor a task ever holds the pivots of all cells. Cells join independently, in units of a block of members
against a block of members and copies, so a cell may be of any size. A unit returns how many partners each member has
and a spanning forest of the links, never all pairs.

A null or empty vector, one of zeros only, one with a null or non-finite component and one without a label link
with nothing; so do vectors of another length. Rows that repeat a vec_id count as one vector (of the least label, then
by hash) and each get its answer. A null vec_id links with nothing. Other columns are not read. An empty
table gives an empty result.
"""

from __future__ import annotations

import math
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, materialise, table
from .components import LIGHT, components

SLACK = 1e-7  # more than the error of arccos near 0
GAIN = 0.5  # a cell is divided if its parts take at most this share of its comparisons
SAMPLE = 20_000  # about so many rows of a cell tell what dividing it would take


def _unit(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Vectors of length one as a matrix, and which rows are usable."""
    n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    width = int(n.max()) if len(n) else 0
    x = np.full((len(n), width), np.nan)
    flat = np.array(lists.flatten().to_numpy(zero_copy_only=False), float)
    keep = np.arange(width)[None, :] < n[:, None]
    x[keep] = flat
    x[~keep] = 0
    with np.errstate(all="ignore"):
        largest = np.abs(x).max(1, initial=0)
        x /= np.where(largest > 0, largest, 1)[:, None]
        norm = np.sqrt((x * x).sum(1))
        good = (n > 0) & np.isfinite(largest) & (largest > 0) & np.isfinite(norm)
        x /= np.where(good, norm, 1)[:, None]
    return x, good, width


CELL = ("label", "size", "path")
PLACED = "label long, size int, path string, rep long, members long, own boolean, v array<{kind}>"


def _divide(reach: float):
    """One block of a cell's rows and the cell's pivots -> a row for the own cell and for each that one is copied to."""

    def run(rows: pa.Table, pivots: pa.Table) -> pa.Table:
        rows = rows.drop_columns(["salt"]).combine_chunks()
        if not pivots.num_rows or not rows.num_rows:
            return rows
        x, p = _unit(rows.column("v").combine_chunks())[0], _unit(pivots.column("v").combine_chunks())[0]
        angle = np.arccos(np.clip(x @ p.T, -1, 1))
        near = angle.argmin(1)
        row, cell = np.nonzero(angle <= angle.min(1)[:, None] + 2 * reach + SLACK)
        out = rows.take(pa.array(row))
        names = pivots.column("rep").to_numpy()[cell]
        path = pa.array([f"{a}/{b}" for a, b in zip(out.column("path").to_pylist(), names.tolist())])
        own = out.column("own").to_numpy(zero_copy_only=False) & (near[row] == cell)
        return out.set_column(out.schema.get_field_index("path"), "path", path).set_column(out.schema.get_field_index("own"), "own", pa.array(own))

    return run


def _join(least: float):
    def run(unit: pa.Table) -> pa.Table:
        x, _, _ = _unit(unit.column("v").combine_chunks())
        left, right = (unit.column(c).to_numpy(zero_copy_only=False) for c in ("left", "right"))
        ids, members = (unit.column(c).to_numpy() for c in ("rep", "members"))
        a, b = np.flatnonzero(left), np.flatnonzero(right)
        linked = (x[a] @ x[b].T >= least) & (ids[a][:, None] != ids[b][None, :])
        r, c = np.nonzero(linked)
        count = np.bincount(r, weights=members[b[c]], minlength=len(a)).astype(np.int64)
        some = count > 0
        names, place = np.unique(np.concatenate([ids[a[r]], ids[b[c]]]), return_inverse=True)
        s, t = place[: len(r)], place[len(r) :]
        root = np.arange(len(names))
        while True:  # least label of each group of links in this unit
            low = root.copy()
            np.minimum.at(low, s, root[t])
            np.minimum.at(low, t, low[s])
            low = low[low]
            if (low == root).all():
                break
            root = low
        tree = root != np.arange(len(names))
        return pa.table(
            {
                "a": np.concatenate([ids[a][some], names[tree]]),
                "b": pa.array(np.concatenate([np.zeros(some.sum(), np.int64), names[root[tree]]]), mask=np.concatenate([np.ones(some.sum(), bool), np.zeros(tree.sum(), bool)])),
                "n": np.concatenate([count[some], np.zeros(tree.sum(), np.int64)]).astype(np.int64),
            }
        )

    return run


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ids(vec_id, label, h1, h2) of usable vectors, and a row for each class of equal ones: label, size, rep (its
    least vec_id), members, v."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0))
    usable = usable.select("vec_id", "label", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(17), "v").alias("h2"), "v")
    key = ("label", "h1", "h2")
    ids = usable.groupBy("vec_id").agg(F.min(F.struct(*key)).alias("x")).select("vec_id", "x.*")
    ids = materialise(ids, "vector-ids", LIGHT)
    count = ids.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("members"))
    whole = usable.groupBy(*key).agg(F.first("v").alias("v"))
    return ids, whole.join(count, list(key)).select("label", F.size("v").alias("size"), *key[1:], "rep", "members", "v")


def _cells(classes: DataFrame, kind: str, reach: float, cell: int | None, fanout: int, rows_a_task: int = 1024) -> DataFrame:
    goal = F.lit(cell) if cell else F.least(F.lit(2048), F.greatest(F.lit(16), F.ceil(F.col("n") / 4))).cast("int")
    placed = classes.select("label", "size", F.lit("").alias("path"), "rep", "members", F.lit(True).alias("own"), "v")
    counts = materialise(placed.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), F.count(F.lit(1)).alias("all")), "cell-counts", LIGHT)
    goals = counts.select("label", "size", goal.alias("goal"))
    open_ = counts.join(goals, ["label", "size"]).where(F.col("n") > F.col("goal"))
    parent = F.regexp_replace("path", "/[^/]*$", "")
    by = [*CELL, "salt"]
    level = 0

    def divided(rows: DataFrame, chosen: DataFrame) -> DataFrame:
        salts = F.ceil(F.col("all") / rows_a_task).cast("int")
        pivots = chosen.select(*CELL, F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), "rep", "v")
        dealt = rows.select(*placed.columns, F.pmod(F.xxhash64("rep"), salts).alias("salt"))
        return dealt.groupBy(*by).cogroup(pivots.groupBy(*by)).applyInArrow(_divide(reach), PLACED.format(kind=kind))

    while not open_.isEmpty():
        share = F.least(F.lit(fanout), F.ceil(F.col("n") / F.col("goal"))) / F.col("n") * float(1 << 62)
        chosen = placed.join(open_, list(CELL)).where("own").where(F.shiftrightunsigned(F.xxhash64("rep", F.lit(level)), 2) < share.cast("long"))
        chosen = materialise(chosen.select(*CELL, "all", "rep", "v"), "pivots", LIGHT)
        some = placed.join(open_, list(CELL)).where(F.shiftrightunsigned(F.xxhash64("rep", F.lit(-1)), 11) / float(1 << 53) < F.lit(float(SAMPLE)) / F.col("all"))
        before = some.groupBy(*CELL).agg((F.count_if("own") * F.count(F.lit(1))).alias("cost"))
        after = divided(some, chosen).groupBy(*CELL).agg(F.count_if("own").alias("n"), F.count(F.lit(1)).alias("all")).withColumn("path", parent)
        after = after.groupBy(*CELL).agg(F.sum(F.col("n") * F.col("all")).alias("parts"))
        worth = materialise(before.join(after, list(CELL)).where(F.col("parts") <= F.col("cost") * GAIN).select(*CELL), "cells-worth", LIGHT)
        taken = open_.join(worth, list(CELL), "left_semi")
        parts = divided(placed.join(taken, list(CELL)), chosen.join(worth, list(CELL), "left_semi"))
        old, placed = placed, materialise(parts.unionByName(placed.join(worth, list(CELL), "left_anti")), "cells")
        forget(old, chosen)
        counts = placed.groupBy(*CELL).agg(F.count_if("own").alias("n"), F.count(F.lit(1)).alias("all")).withColumn("parent", parent)
        new = counts.join(worth.withColumnRenamed("path", "parent"), ["label", "size", "parent"], "left_semi").where(F.col("path") != F.col("parent")).select(*CELL, "n", "all")
        open_ = materialise(new.join(goals, ["label", "size"]).where(F.col("n") > F.col("goal")), "cell-counts", LIGHT)
        level += 1
    return placed if level else materialise(placed, "cells")


def link(vectors: DataFrame, least: float = 0.93, cell: int | None = None, block: int = 1024, fanout: int = 32) -> DataFrame:
    """vec_id, n_links, component_id: one row per row of vectors(vec_id, embedding, label).

    cell: how many classes need no division; if it isn't given, a quarter of the label's classes, 16 to 2048."""
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    ids, classes = _classes(vectors)
    classes = materialise(classes, "vector-classes")
    placed = _cells(classes, kind, math.acos(least), cell, fanout)
    at = list(CELL)
    blocks = placed.groupBy(*at).agg(F.ceil(F.count_if("own") / block).cast("int").alias("ln"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("rn"), F.count(F.lit(1)).alias("all"))
    dealt = placed.join(blocks.where("ln > 0 and all > 1"), at).withColumn("h", F.xxhash64("rep", F.lit(5)))
    zero, no, yes = F.lit(0), F.lit(False), F.lit(True)
    unit = lambda i, j, left, right: F.struct(i.alias("i"), j.alias("j"), left.alias("left"), right.alias("right"))
    mine = lambda n: F.pmod("h", F.greatest(n, F.lit(1)))
    every = lambda n, one: F.transform(F.sequence(zero, F.greatest(n - 1, zero)), one)
    many = F.concat(
        every(F.col("ln"), lambda i: unit(i, mine(F.col("rn")), no, yes)),
        F.when(F.col("own"), every(F.col("rn"), lambda j: unit(mine(F.col("ln")), j, yes, no))).otherwise(F.array().cast("array<struct<i:int,j:int,left:boolean,right:boolean>>")),
    )
    units = F.when((F.col("ln") == 1) & (F.col("rn") == 1), F.array(unit(zero, zero, F.col("own"), yes))).otherwise(many)
    sent = dealt.select(*at, "rep", "members", "v", F.explode(units).alias("u")).select(*at, "rep", "members", "v", "u.*")
    found = sent.groupBy(*at, "i", "j").applyInArrow(_join(least), "a long, b long, n long")
    found = materialise(found, "vector-links", LIGHT)
    number = found.where(F.col("b").isNull()).groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    component = components(found.where(F.col("b").isNotNull()).select("a", "b")).select(F.col("node").alias("rep"), "component")
    per = classes.select("label", "h1", "h2", "rep", "members").join(number, "rep", "left").join(component, "rep", "left")
    known = ids.join(per, ["label", "h1", "h2"]).select(
        "vec_id", (F.coalesce("others", F.lit(0).cast("long")) + F.col("members") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    answer = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(known, "vec_id", "left")
    return answer.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = link(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


OP5_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
), g AS (SELECT * FROM e WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM g x JOIN g y ON x.label = y.label AND x.vec_id <> y.vec_id AND list_cosine_similarity(x.v, y.v) >= 0.93),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT c.vec_id, coalesce(n.n, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""
