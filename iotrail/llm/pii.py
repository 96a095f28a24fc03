"""Operator 8: personal data by pattern, checksum and context, with Column expressions only.

find(docs) -> doc_id, spans. Patterns propose; an e-mail address and a phone number are confirmed by their
shape, an IP address by its parts, a card number by Luhn, an IBAN by mod-97; a national id number (ddd-dd-dddd)
has no checksum and is kept only with a context word nearby. Context words within `window` code points before
a span, or in it, raise its score. Base kinds (email, ip, card, phone) are reported whatever their score;
the kinds that the method adds are iban and national_id.

Null and empty texts have no spans. Repeated rows and null doc_ids give a row each. Other columns are not read.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans as S
from .common import table, texts_of

KINDS = ("email", "ip", "card", "phone")

# Possessive forms and look-behinds keep each pattern linear on long runs; \G lets a match begin
# right after the one before it, as it could without the look-behind.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
NATIONAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

#: kind: (score without context, words that raise it)
CONTEXT = {
    "email": (0.8, "mail|contact|write to|address|kontakt|courriel|correo"),
    "ip": (0.6, "ip|host|server|address|login|client"),
    "card": (0.7, "card|visa|credit|payment|karte|carte|tarjeta"),
    "phone": (0.6, "phone|tel|call|mobile|fax|telefon|llame"),
    "iban": (0.8, "iban|bank|account|konto|compte|cuenta"),
    "national_id": (0.2, "ssn|social security|national id|insurance number"),
}
GAIN = 0.2


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def _characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def luhn(number: Column) -> Column:
    """True if a string of digits passes the Luhn check."""

    def total(ds: Column) -> Column:
        one = lambda c, i: S.let(c.cast("int"), lambda d: F.when((F.size(ds) - i) % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d))
        return F.aggregate(F.transform(ds, one), F.lit(0), lambda acc, x: acc + x) % 10 == 0

    return S.let(_characters(number), total)


def mod97(iban: Column) -> Column:
    """True if an IBAN without spaces passes the ISO 7064 check."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, F.lit(1), F.lit(4)))

    def step(acc: Column, character: Column) -> Column:
        c = F.ascii(character)
        return F.when(c >= 65, (acc * 100 + c - 55) % 97).otherwise((acc * 10 + c - 48) % 97)

    return F.aggregate(_characters(turned), F.lit(0), step) == 1


def part_ok(part: Column) -> Column:
    value = F.regexp_replace(part, "^0+", "")
    return (F.length(value) < 3) | ((F.length(value) == 3) & (value <= "255"))


def _scored(text: Column, spans: Column, window: int) -> Column:
    def one(s: Column, pieces: Column) -> Column:
        near = F.lower(F.concat(S.cut(pieces, F.greatest(F.lit(0), s["start"] - window), s["start"]), s["text"]))
        score = F.lit(None).cast("double")
        for kind, (base, words) in CONTEXT.items():
            gain = GAIN if kind != "national_id" else 0.5
            score = F.when(s["kind"] == kind, base + F.when(near.rlike(rf"(?<![a-z])(?:{words})(?![a-z])"), gain).otherwise(0.0)).otherwise(score)
        return F.struct(*(s[c].alias(c) for c in ("start", "rank", "end", "kind", "text")), F.round(score, 3).alias("score"))

    scored = lambda spans: S.let(S.chunks(text), lambda pieces: F.transform(spans, lambda s: one(s, pieces)))
    return S.let(spans, lambda spans: F.when(F.size(spans) > 0, scored(spans)).otherwise(spans))


def find(docs: DataFrame, window: int = 40, least_score: float = 0.5) -> DataFrame:
    text = F.col("text")
    n_digits = lambda s: F.length(digits(s["text"]))
    email = F.when(text.contains("@"), S.matches(text, EMAIL, "email", 0)).otherwise(S.none())
    ip = S.keep(S.matches(text, IP, "ip", 1), lambda s: F.forall(F.split(s["text"], r"\."), part_ok))
    card = S.keep(S.matches(text, CARD, "card", 2), lambda s: F.when(n_digits(s).between(14, 19), luhn(digits(s["text"]))).otherwise(False))
    phone = F.when(text.contains("+"), S.keep(S.matches(text, PHONE, "phone", 3), lambda s: n_digits(s).between(10, 15))).otherwise(S.none())
    iban = S.keep(S.matches(text, IBAN, "iban", 4), lambda s: mod97(F.regexp_replace(s["text"], " ", "")))
    national = S.matches(text, NATIONAL, "national_id", 5)
    found = texts_of(docs).withColumn("base", F.concat(email, ip, card, phone)).withColumn("added", F.concat(iban, national))
    return found.select(
        "doc_id",
        F.concat(_scored(text, F.col("base"), window), S.keep(_scored(text, F.col("added"), window), lambda s: s["score"] >= least_score)).alias("spans"),
    )


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, all_ = find(table(spark, sf_dir, "documents")), F.col("spans")
    base = F.filter(all_, lambda s: s["rank"] < len(KINDS))
    return found.select(
        "doc_id",
        *(S.count(all_, k).alias(f"n_{k}") for k in KINDS),
        F.sha2(S.joined(base).cast("binary"), 256).alias("base_sha256"),
        S.joined(all_).alias("spans"),
        F.array_join(F.transform(F.array_sort(all_), lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
    )
