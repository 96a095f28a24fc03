"""Operator 2: near-duplicate documents by bottom-k sketches from one hash function.

A document is the set of its distinct word shingles (64-bit hashes; A-Z lower-cased, words apart by ASCII white
space; with fewer words than a shingle has, all words are one). Documents of equal sets form a class, and one
stands for it. Each of these keeps the k least hashes of its set. Inverted lists of the retained values give the
pairs that overlap, the sketch of the union estimates their similarity (from 4 k values, for the documents that
are in a list), and what is estimated at or above threshold - margin is confirmed on the full sets of the whole
texts: 100 * intersection >= percent * union.

A list can be very long, so pairs are never formed from all of it:
- three sketch sizes: lists of k values only tell which documents may have a partner at all; these get sketches of
  4 k values, and the lists that pairs come from are made anew from those, with half the margin. Documents in a list
  of more than `LONG` get sketches of 16 k values (up to that size the whole set), and lists of these take the long
  ones' place: families of near misses (forms, licences, product pages) are told from copies there;
- no partner: an entry whose document shares too few values with others for any size of partner in its list goes;
- rare first: two sketches that must share c of k values share one among the k - c + 1 rarest of either, so only
  these are listed (values are counted over all sketches; ones found once need no list);
- what is left: an entry says how many values its document has from there on in that order that others have too. A pair is
  met only in a list from which on both have as many as sets of their two sizes must share;
- peeling: each round takes a few members of every list, the same ones in all lists that hold them and those with
  the fewest values of their own first (the middle of a group of copies), compares them with the rest and then
  leaves them out, 16 times as many the next round, so that every pair of a list is met once and none is capped;
- components: pairs already connected are not compared, and a list whose members are connected is left.

The margin is 4.5 standard errors (0.2 for a sketch of 64 and large sets) and shrinks with the error for sets that
are not much larger than the sketch: a pair exactly at the threshold is overlooked with a chance of about 1e-5,
one above it sooner not; sets of at most k * threshold values are never overlooked.

Null and empty texts, and texts of white space, have an empty set, are linked with nothing and are kept. A null
doc_id is linked with nothing. Rows that repeat a doc_id each get the same answer; doc_id is taken to identify a
text. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordhash as H
from .common import forget, list_array, materialise, slices, table, texts_of
from .components import LIGHT, merge


LONG = 32  # members of a list, beyond which they are told apart by finer sketches


def sets(docs: DataFrame, size: int, k: int) -> DataFrame:
    """doc_id, n (set size), h1, h2 (of the whole set), sketch (its k least hashes, ascending as unsigned)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                values, n = H.shingle_sets(b.column("text"), size)
                till = np.cumsum(n)
                both = []
                for salt in (0x51ED270B, 0xB492B66F):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(H.mix(values ^ np.uint64(salt)))])
                    both.append(pa.array((total[till] - total[till - n]).view(np.int64)))
                kept = np.arange(len(values)) - np.repeat(till - n, n) < k
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(n.astype(np.int64)), *both, list_array(values[kept].view(np.int64), np.minimum(n, k), pa.int64())], names=["doc_id", "n", "h1", "h2", "sketch"]
                )

    return texts_of(docs).mapInArrow(run, "doc_id long, n long, h1 long, h2 long, sketch array<long>")


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """pairs(a, b) whose full sets are similar enough. texts(doc_id, text) has one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "ta", 1 << 20):
                (va, na), (vb, nb) = (H.shingle_sets(b.column(c), size) for c in ("ta", "tb"))
                ia, ib, good = 0, 0, np.zeros(b.num_rows, bool)
                for r, (x, y) in enumerate(zip(na.tolist(), nb.tolist())):
                    common = len(np.intersect1d(va[ia : ia + x], vb[ib : ib + y], assume_unique=True))
                    good[r] = common > 0 and 100 * common >= percent * (x + y - common)
                    ia, ib = ia + x, ib + y
                yield b.select(["a", "b"]).filter(pa.array(good))

    for c in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"t{c}")), c)
    return pairs.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _estimate(sa: Column, sb: Column, k: Column) -> Column:
    """Similarity from the sketch of the union. Hashes are ordered as unsigned numbers."""
    key = lambda x: F.transform(x, lambda v: v.bitwiseXOR(F.lit(-(1 << 63))))
    union = F.slice(F.array_sort(key(F.array_union(sa, sb))), 1, k)
    shared = F.array_intersect(union, key(F.array_intersect(sa, sb)))
    return F.size(shared) / F.size(union)


def link(docs: DataFrame, size: int = 5, percent: int = 80, k: int = 64, errors: float = 4.5) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of docs."""
    threshold = percent / 100
    every = materialise(sets(docs, size, k), "shingle-sets")
    same = ["n", "h1", "h2"]
    reps = materialise(
        every.where((F.col("n") > 0) & F.col("doc_id").isNotNull()).groupBy(*same).agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.first("sketch").alias("sketch")), "shingle-reps", LIGHT
    )
    component = _components_of(docs, reps, size, percent, k, threshold, errors)
    shared = reps.where(F.col("last") > F.col("rep")).select(*same, "rep")
    ids = every.select("doc_id", *same).join(shared, same, "left")
    ids = materialise(ids.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep")), "shingle-ids", LIGHT)
    if component is None:
        return ids.select("doc_id", "n_shingles", F.col("rep").alias("component_id"))
    found = ids.join(component.select(F.col("node").alias("rep"), "component"), "rep", "left")
    return found.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))


def _margin(n: Column, k: int | Column, threshold: float, errors: float) -> Column:
    """Sampling error that is allowed for: less where the sketch is much of the union (of n / threshold at most)."""
    return errors * F.sqrt(threshold * (1 - threshold) / F.lit(k)) * F.sqrt(F.greatest(F.lit(0.0), 1 - F.lit(k) * threshold / n))


def _shared(na: Column, nb: Column, k: int | Column, threshold: float, errors: float) -> Column:
    """How many values the sketches of two sets of these sizes share at least if the sets are similar enough.

    The larger set's sketch is a sample of it, of which the smaller set holds the share p or more; if it is the
    whole set there is no error."""
    large, small = F.greatest(na, nb), F.least(na, nb)
    kept = F.least(F.lit(k), large)
    p = threshold * (1 + small / large) / (1 + threshold)
    return kept * p - errors * F.sqrt(kept * p * (1 - p) * (1 - kept / large)) - 1e-9


def _lists(reps: DataFrame, k: int, threshold: float, errors: float) -> DataFrame:
    """(v, rep, n, left, own): inverted lists of the rarest retained values. left: how many retained values found
    elsewhere too the document has from this one on; own: the share of its values that no other has."""
    postings = reps.select("rep", "n", F.size("sketch").alias("k"), F.explode("sketch").alias("v"))
    counts = postings.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    mine = postings.join(counts, "v").groupBy("rep", "n", "k").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("shared"))
    few = F.col("n") <= math.floor(threshold * k)
    least = F.ceil(F.when(few, threshold * F.col("n")).otherwise((threshold - _margin(F.col("n"), k, threshold, errors)) * F.col("k")) - 1e-9)
    rare = mine.withColumn("room", (F.size("shared") - least + 1).cast("int")).where("room > 0")
    own = (1 - F.size("shared") / F.col("k")).alias("own")
    entries = rare.select("rep", "n", own, F.size("shared").alias("all"), F.posexplode(F.slice("shared", F.lit(1), F.col("room"))).alias("at", "x"))
    return entries.select(F.col("x.v").alias("v"), "rep", "n", (F.col("all") - F.col("at")).alias("left"), "own")


def _with_partners(lists: DataFrame, threshold: float, errors: float) -> DataFrame:
    """lists(v, n, left, k, ...) without entries that have no partner in their list, by the sizes found there.

    What two sets must share grows with the smaller one's size; with the larger one's it grows and then falls (where
    its sketch is a sample), so the least is at one end of the range of sizes."""
    n = F.col("n")
    range_ = lists.groupBy("v").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("rep").alias("x"), F.max("rep").alias("y")).where("x < y")
    small = F.least(n, F.greatest(F.col("lo"), threshold * n))
    large = F.greatest(n, F.least(F.col("hi"), n / threshold))
    needed = F.least(_shared(n, small, F.col("k"), threshold, errors), _shared(n, large, F.col("k"), threshold, errors))
    return lists.join(range_, "v").where(F.col("left") >= needed).select(*lists.columns)


def _in_pairs(rows: DataFrame, pairs: DataFrame, most: int = 500_000) -> DataFrame:
    """rows(doc_id, ...) of the documents in pairs(a, b), so that joins shuffle no others. Their ids are broadcast if there
    are at most `most` (counted; 8 bytes each); if there are more, all rows are left in, which changes no result."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    ids = materialise(ids, "shingle-ids", 1)
    return rows.join(F.broadcast(ids), "doc_id", "left_semi") if ids.count() <= most else rows


def _start(texts: DataFrame, sketches: DataFrame, size: int, wide: int, threshold: float, errors: float) -> tuple[DataFrame, DataFrame | None]:
    """v, rep, n, left, own, k (of the sketches), component: the lists that pairs come from; and the finer sketches.

    A pair that meets in a long list has both documents in those of the finer sketches, and the other lists stay, so
    no pair is lost."""
    named = sketches.withColumnRenamed("doc_id", "rep")
    every = materialise(_with_partners(_lists(named, wide, threshold, errors).withColumn("k", F.lit(wide)), threshold, errors), "shingle-lists", LIGHT)
    long = materialise(every.groupBy("v").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > LONG).select("v"), "shingle-long", LIGHT)
    if long.isEmpty():
        return every.withColumn("component", F.col("rep")), None
    hot = every.join(long, "v", "left_semi").select(F.col("rep").alias("doc_id")).distinct()
    fine = 4 * wide
    finer = materialise(sets(texts.join(hot, "doc_id", "left_semi"), size, fine).select("doc_id", "n", "sketch"), "shingle-finer", LIGHT)
    # Lists of the two kinds are apart: a number of the finer ones is mixed once more.
    apart = _lists(finer.withColumnRenamed("doc_id", "rep"), fine, threshold, errors).withColumn("k", F.lit(fine)).withColumn("v", F.xxhash64("v"))
    both = every.join(long, "v", "left_anti").unionByName(_with_partners(apart, threshold, errors))
    out = materialise(both.withColumn("component", F.col("rep")), "shingle-lists", LIGHT)
    forget(every, long)
    return out, finer


def _components_of(docs: DataFrame, reps: DataFrame, size: int, percent: int, k: int, threshold: float, errors: float) -> DataFrame | None:
    first = materialise(_lists(reps, k, threshold, errors).select("v", "rep"), "shingle-lists", LIGHT)
    met = first.groupBy("v").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x < y").select("v")
    listed = materialise(first.join(met, "v", "left_semi").select(F.col("rep").alias("doc_id")).distinct(), "shingle-listed", LIGHT)
    forget(first)
    if listed.isEmpty():
        return None
    texts = materialise(texts_of(docs).join(listed, "doc_id").dropDuplicates(["doc_id"]), "shingle-texts")
    wide = 4 * k
    sketches = materialise(sets(texts, size, wide).select("doc_id", "n", "sketch"), "shingle-sketches", LIGHT)
    lists, finer = _start(texts, sketches, size, wide, threshold, errors)
    samples = sketches.withColumn("k", F.lit(wide))
    if finer is not None:
        samples = samples.unionByName(finer.withColumn("k", F.lit(4 * wide)))
    component: DataFrame | None = None
    leaders = 1
    while not lists.isEmpty():
        order = F.struct("own", F.xxhash64("rep", F.lit(leaders)).alias("h"), "rep", "n", "left", "component")
        lead = lists.groupBy("v", F.pmod(F.xxhash64("rep"), F.lit(leaders)).alias("part")).agg(F.min(order).alias("x"))
        lead = materialise(lead.select("v", F.col("x.rep").alias("lr"), F.col("x.n").alias("ln"), F.col("x.left").alias("ll"), F.col("x.component").alias("lc")), "shingle-leaders", LIGHT)
        met = lists.join(lead, "v").where(
            (F.col("rep") != F.col("lr"))
            & (F.col("component") != F.col("lc"))
            & (F.least("n", "ln") >= threshold * F.greatest("n", "ln") - 1e-9)
            & (F.least("left", "ll") >= _shared(F.col("n"), F.col("ln"), F.col("k"), threshold, errors))
        )
        met = met.groupBy(F.least("rep", "lr").alias("a"), F.greatest("rep", "lr").alias("b")).agg(F.max("k").alias("k"))
        met = materialise(met, "shingle-pairs", LIGHT)
        pairs, some, kept = met, _in_pairs(samples, met), F.col("k")
        for c in ("a", "b"):
            pairs = pairs.join(some.select(F.col("doc_id").alias(c), "k", F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")), [c, "k"])
        enough = F.size(F.array_intersect("sa", "sb")) >= _shared(F.col("na"), F.col("nb"), kept, threshold, errors)
        needed = threshold - _margin(F.greatest("na", "nb"), kept, threshold, errors) - 1e-9
        likely = pairs.where(F.when(enough, _estimate(F.col("sa"), F.col("sb"), kept) >= needed).otherwise(False)).select("a", "b")
        likely = materialise(likely, "shingle-likely", LIGHT)
        links = materialise(confirm(likely, _in_pairs(texts, likely), size, percent), "shingle-links", LIGHT)
        if not links.isEmpty():
            component, old = merge(component, links), component
            forget(old)
        rest = lists.join(lead.select("v", F.col("lr").alias("rep")), ["v", "rep"], "left_anti")
        columns = lists.columns
        if component is not None:
            rest = rest.drop("component").join(component.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        rest = materialise(rest.select(*columns), "shingle-lists", LIGHT)
        open_ = rest.groupBy("v").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("v")
        old, lists = lists, materialise(rest.join(materialise(open_, "shingle-open", LIGHT), "v", "left_semi").select(*columns), "shingle-lists", LIGHT)
        forget(old, rest, lead, links, met, likely)
        leaders *= 16
    forget(texts, sketches, finer, lists)
    return component


def keep_one(docs: DataFrame, most: int = 2_000_000, **options) -> DataFrame:
    """One document of each group, that of the least doc_id, with the columns docs has.

    Rows are linked by a number of their own, so rows that repeat a doc_id or have none are documents like others.
    The numbers of the rows that go are broadcast if there are at most `most` (counted; 8 bytes each), so that whole texts
    are not shuffled; if there are more, a join shuffles rows by number, with the same result."""
    rows = materialise(docs.withColumn("__row", F.monotonically_increasing_id()), "keep-rows", compression="zstd")
    found = link(rows.select(F.col("__row").alias("doc_id"), "text"), **options).select(F.col("doc_id").alias("__row"), "component_id")
    known = materialise(found.join(rows.select("__row", F.col("doc_id").cast("long").alias("id")), "__row"), "keep-known", LIGHT)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "__row")).alias("x")
    groups = known.groupBy("component_id").agg(first, F.count(F.lit(1)).alias("size")).where("size > 1").select("component_id", F.col("x.__row").alias("stays"))
    groups = materialise(groups, "keep-groups", LIGHT)
    gone = materialise(known.join(groups, "component_id").where(F.col("__row") != F.col("stays")).select("__row"), "keep-gone", LIGHT)
    if gone.count() <= most:
        gone = F.broadcast(gone)
    return rows.join(gone, "__row", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = link(table(spark, sf_dir, "documents"), size=3, percent=85)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
  JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))
), r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)
"""
