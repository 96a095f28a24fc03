"""Operator 4: secrets by pattern and by character Markov models, with Column expressions only.

Base kinds (assign, access, hex) come from patterns. The method adds kind `random`: a token of `least`
or more characters that no base span touches and that a first-order Markov model of random strings explains
better than one of ordinary identifiers, by a log-likelihood ratio over `margin`.

Both models are trained here from labelled samples: random strings are digests of row numbers in
hexadecimal and base 64 together with the values that the base patterns find in the sample; ordinary
identifiers are the words of the sample that no base pattern touches, alone and joined in snake and
camel case. The sample is the `sample_docs` documents of lowest hash of doc_id, of rows that repeat one the least
text (a documented bound for training only); scanning covers every whole text. The trained table has at most 2 x 128 x 128 counts.

Null and empty texts have no spans. Repeated rows and null doc_ids give a row each. Other columns are not
read. An empty table gives an empty result; its models come from the digests alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans as S
from .common import table, texts_of

KINDS = ("assign", "access", "hex")

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+[A-Za-z0-9+/_.=-]++"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}+"
WORDS = r"[A-Za-z0-9_]{4,}"

SIZE = 128  # code points below this have their own state; state 0 also stands for the start


def base_spans(text: Column) -> Column:
    assign = F.when(
        text.rlike("[:=]"),
        S.keep(S.matches(text, ASSIGN, "assign", 0), lambda s: F.length(F.regexp_replace(s["text"], ASSIGN_VALUE, "")) >= 6),
    ).otherwise(S.none())
    access = F.when(text.contains("AKIA"), S.matches(text, ACCESS, "access", 1)).otherwise(S.none())
    return F.concat(assign, access, S.matches(text, HEX, "hex", 2))


def _transitions(token: Column) -> Column:
    """Index into the flattened table, one per character: from the state before to its own."""

    def pairs(states: Column) -> Column:
        return F.zip_with(F.concat(F.array(F.lit(0)), F.slice(states, F.lit(1), F.size(states) - 1)), states, lambda a, b: a * SIZE + b)

    code = lambda c: F.when(F.ascii(c) < SIZE, F.ascii(c)).otherwise(0)
    return S.let(F.transform(F.regexp_extract_all(token, F.lit("(?s)."), F.lit(0)), code), lambda states: F.when(F.size(states) > 0, pairs(states)).otherwise(states))


def train(docs: DataFrame, sample_docs: int = 2000, digests: int = 4000, smooth: float = 0.1) -> list[float]:
    """Log-likelihood ratios (random against ordinary) by transition, flattened; base-64 symbols are smoothed."""
    spark = docs.sparkSession
    rank = F.xxhash64("doc_id")
    last = texts_of(docs).select(rank.alias("r")).distinct().orderBy("r").limit(sample_docs).agg(F.max("r")).first()[0]
    chosen = texts_of(docs).where(rank <= (F.lit(last) if last is not None else F.lit(0)))
    sample = chosen.groupBy("doc_id").agg(F.min("text").alias("text")).repartition(spark.sparkContext.defaultParallelism, "doc_id")
    spans = sample.select("text", base_spans(F.col("text")).alias("base"))
    found = spans.select(F.explode("base").alias("s")).select(
        F.lit(1).alias("label"), F.regexp_replace(F.col("s.text"), ASSIGN_VALUE, "").alias("token")
    )
    clean = S.masked(F.col("text"), F.col("base"), " ")
    words = spans.select(F.array_distinct(F.regexp_extract_all(clean, F.lit(WORDS), F.lit(0))).alias("w"))
    one = words.select(F.explode("w").alias("token")).distinct()
    two = words.select(
        F.explode(
            F.zip_with(
                F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))),
                F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))),
                lambda a, b: F.array(F.concat(F.lower(a), F.lit("_"), F.lower(b)), F.concat(F.lower(a), F.initcap(b))),
            )
        ).alias("pair")
    ).select(F.explode("pair").alias("token"))
    number = spark.range(digests).select(F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("hex"))
    random = number.select(F.explode(F.array("hex", F.base64(F.unhex("hex")))).alias("token"))
    labelled = (
        found.unionByName(random.select(F.lit(1).alias("label"), "token"))
        .unionByName(one.select(F.lit(0).alias("label"), "token"))
        .unionByName(two.select(F.lit(0).alias("label"), "token"))
    )
    rows = labelled.where(F.length("token") > 0).select("label", F.explode(_transitions(F.col("token"))).alias("at")).groupBy("label", "at").count().collect()
    counts = {(r["label"], r["at"]): r["count"] for r in rows}
    symbols = [ord(c) for c in "+-/=_"] + [c for c in range(48, 123) if chr(c).isalnum()]
    ratios = [0.0] * (SIZE * SIZE)
    for a in [0, *symbols]:
        row = {label: sum(counts.get((label, a * SIZE + b), 0) for b in symbols) + smooth * len(symbols) for label in (0, 1)}
        for b in symbols:
            p = {label: (counts.get((label, a * SIZE + b), 0) + smooth) / row[label] for label in (0, 1)}
            ratios[a * SIZE + b] = math.log(p[1] / p[0])
    return ratios


def score(token: Column, ratios: list[float]) -> Column:
    """Log-likelihood ratio of a token: over 0 if it looks random."""
    model = F.split(F.lit(",".join(f"{x:.4f}" for x in ratios)), ",").cast("array<double>")
    return F.aggregate(_transitions(token), F.lit(0.0), lambda acc, at: acc + F.get(model, at))


def annotate(rows: DataFrame, ratios: list[float], least: int, margin: float) -> DataFrame:
    """rows(text, ...) with a column __spans; null texts have none."""
    text, base = F.col("text"), F.col("__base")
    tokens = S.let(S.matches(text, TOKEN % least, "random", 3), lambda t: S.apart(t, base))
    scored = F.transform(tokens, lambda s: F.struct(*(s[c].alias(c) for c in ("start", "rank", "end", "kind", "text")), F.round(score(s["text"], ratios), 3).alias("score")))
    added = S.keep(scored, lambda s: s["score"] > margin)
    based = rows.withColumn("__base", F.when(text.isNotNull(), base_spans(text)).otherwise(S.none()))
    return based.withColumn("__spans", F.when(text.isNotNull(), F.concat(base, added)).otherwise(S.none())).drop("__base")


def find(docs: DataFrame, ratios: list[float], least: int = 20, margin: float = 9.0) -> DataFrame:
    """doc_id, spans."""
    return annotate(texts_of(docs), ratios, least, margin).select("doc_id", F.col("__spans").alias("spans"))


def redact(docs: DataFrame, ratios: list[float], mark: str = "[SECRET]", least: int = 20, margin: float = 9.0) -> DataFrame:
    """docs with every secret in `text` replaced; null texts stay null, other columns stay as they are."""
    rows = annotate(docs, ratios, least, margin)
    return rows.withColumn("text", F.when(F.size("__spans") > 0, S.masked(F.col("text"), F.col("__spans"), mark)).otherwise(F.col("text"))).select(*(F.col(f"`{c}`") for c in docs.columns))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, all_ = table(spark, sf_dir, "documents"), F.col("spans")
    found = find(docs, train(docs))
    base = F.filter(all_, lambda s: s["rank"] < len(KINDS))
    return found.select(
        "doc_id",
        *(S.count(all_, k).alias(f"n_{k}") for k in KINDS),
        F.sha2(S.joined(base).cast("binary"), 256).alias("base_sha256"),
        S.joined(all_).alias("spans"),
    )
