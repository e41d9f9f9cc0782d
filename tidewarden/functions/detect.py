"""Detectors as expressions: redaction, injection, borderline phrases, and named entities found elsewhere."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.functions import patterns as P

INJECTION_FLAG, BORDERLINE_FLAG = "injection_suspected", "borderline_suspected"

# Entity types that are redacted besides the native ones, and the least score.
ENTITY_LABELS = ("PERSON", "LOCATION", "NRP", "CRYPTO", "MAC_ADDRESS", "MEDICAL_LICENSE", "US_PASSPORT", "US_DRIVER_LICENSE", "US_BANK_NUMBER", "US_ITIN", "UK_NHS", "DATE_TIME")
ENTITY_SCORE = 0.5
ENTITIES = "array<struct<type:string,start:int,end:int,score:double>>"


def may_match(text: Column, label: str) -> Column:
    """False only where a recognizer has no match in a text."""
    texts, pattern = P.NEEDS[label]
    needs = [F.contains(text, F.lit(t)) for t in texts] + ([F.rlike(text, F.lit(pattern))] if pattern else [])
    return reduce(Column.__or__, needs)


def with_redaction(df: DataFrame, text: str, out: str = "redacted", flags: str = "pii_flags") -> DataFrame:
    """Adds the redacted text and the flags of what was redacted.

    Recognizers run one after the other on the evolving text, one projection each, so the chain holds each
    replacement once. A match never contains its own label, so a recognizer fired exactly if it changed the text.
    A recognizer runs only where the text has what each of its matches has (patterns.NEEDS).
    """
    now = df.withColumn("_t0", F.coalesce(F.col(text), F.lit("")))
    for i, (label, pattern) in enumerate(P.PII):
        t = F.col(f"_t{i}")
        now = now.withColumn(f"_t{i + 1}", F.when(may_match(t, label), F.regexp_replace(t, P.java(pattern), f"<{label}>")).otherwise(t))
    found = F.array(*[F.when(F.col(f"_t{i}") != F.col(f"_t{i + 1}"), f"pii:{label}") for i, (label, _) in enumerate(P.PII)])
    now = now.withColumn(flags, F.filter(found, lambda x: x.isNotNull())).withColumn(out, F.col(f"_t{len(P.PII)}"))
    return now.drop(*[f"_t{i}" for i in range(len(P.PII) + 1)])


def matches_injection(text: Column) -> Column:
    return F.rlike(text, F.lit(P.INJECTION_NEEDS)) & F.rlike(text, F.lit("|".join(f"(?:{P.java(p)})" for p in P.INJECTION)))


def decoded(text: Column) -> Column:
    """Decoded forms of the first bytes of a text: the URL-decoded text and its base64 runs."""
    scan = F.substring(text.cast("binary"), 1, P.DECODE_BYTES).cast("string")
    url = F.when(F.contains(scan, F.lit("%")), F.try_url_decode(scan))
    runs = F.slice(F.regexp_extract_all(scan, F.lit(P.BASE64_JAVA), F.lit(0)), 1, P.DECODE_RUNS)
    # Runs without full padding are not decoded.
    plain = F.transform(runs, lambda r: F.when(F.octet_length(r) % 4 == 0, F.try_to_binary(r, F.lit("base64"))).cast("string"))
    return F.filter(F.concat(F.array(url), plain), lambda x: x.isNotNull())


def injection(text: Column) -> Column:
    """Whether a text, or else a decoded form of it, has an injection phrase."""
    text = F.coalesce(text, F.lit(""))
    maybe = F.contains(text, F.lit("%")) | F.rlike(text, F.lit(P.BASE64_NEEDS))
    return F.when(matches_injection(text), True).when(maybe, F.exists(decoded(text), matches_injection)).otherwise(False)


def borderline(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.rlike(text, F.lit(P.BORDERLINE_NEEDS)) & F.rlike(text, F.lit(P.java(P.BORDERLINE)))


def with_entities(df: DataFrame, text: str, entities: str, redacted: str = "redacted", flags: str = "pii_flags") -> DataFrame:
    """Overlays entities (offsets into the original text's bytes) on a native redaction.

    Kept entities are replaced, the longest value first, where they are still in the text; the flags are sorted. Without
    entities (null: the recognizer failed) the native result stands.
    """
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    size = F.octet_length(raw)
    kept = F.filter(F.col(entities), lambda e: e["type"].isin(*ENTITY_LABELS) & (e["score"] >= ENTITY_SCORE) & (e["start"] >= 0) & (e["end"] <= size) & (e["start"] < e["end"]))
    hits = F.array_distinct(F.transform(kept, lambda e: F.struct(e["type"].alias("label"), F.substr(raw, e["start"] + 1, e["end"] - e["start"]).cast("string").alias("value"))))
    # The position breaks ties, so equally long values keep their order.
    ordered = F.array_sort(F.transform(hits, lambda h, i: F.struct((-F.octet_length(h["value"])).alias("n"), i.alias("i"), h["label"].alias("label"), h["value"].alias("value"))))
    start = F.struct(F.col(redacted).alias("text"), F.col(flags).alias("flags"))

    def step(acc: Column, h: Column) -> Column:
        there = F.contains(acc["text"], h["value"])
        return F.struct(
            F.when(there, F.replace(acc["text"], h["value"], F.concat(F.lit("<"), h["label"], F.lit(">")))).otherwise(acc["text"]).alias("text"),
            F.when(there, F.array_union(acc["flags"], F.array(F.concat(F.lit("pii:"), h["label"])))).otherwise(acc["flags"]).alias("flags"),
        )

    done = df.withColumn("_done", F.when(F.col(entities).isNotNull(), F.aggregate(ordered, start, step)))
    none = F.col("_done").isNull()
    return done.withColumn(redacted, F.when(none, F.col(redacted)).otherwise(F.col("_done.text"))).withColumn(flags, F.when(none, F.col(flags)).otherwise(F.array_sort("_done.flags"))).drop("_done")


def recognized(df: DataFrame, text: str, factory: Callable[[], Callable[[str], list[tuple[str, int, int, float]]]], out: str = "entities") -> DataFrame:
    """df with the entities that a recognizer finds in each text (null: empty).

    factory() makes the recognizer once in each task; it gives type, start and end in UTF-8 bytes, and score of each
    entity. Where the factory or a text's recognition fails, the entities are null, so the native result stands.
    """
    entity = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    names = [f.name for f in entity.value_type]

    @F.arrow_udf(ENTITIES)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            recognize = factory()
        except Exception:  # no model here: all texts fall back
            recognize = None
        for texts in batches:
            rows = []
            for t in texts.to_pylist():
                try:
                    rows.append([dict(zip(names, e, strict=True)) for e in recognize(t)] if recognize else None)
                except Exception:  # this text falls back
                    rows.append(None)
            yield pa.array(rows, entity)

    return df.withColumn(out, found(F.coalesce(F.col(text), F.lit(""))))


@dataclass(frozen=True)
class Detector:
    """Redaction, injection and borderline detection; entities names a column of recognized entities, recognizer makes them (see recognized())."""

    entities: str | None = None
    recognizer: Callable | None = None

    def redact(self, df: DataFrame, text: str, out: str = "redacted", flags: str = "pii_flags") -> DataFrame:
        df = with_redaction(df, text, out, flags)
        if self.recognizer:
            made = "_tidewarden_entities"
            return with_entities(recognized(df, text, self.recognizer, made), text, made, out, flags).drop(made)
        return with_entities(df, text, self.entities, out, flags) if self.entities else df

    def detect_injection(self, text: Column) -> Column:
        return injection(text)

    def detect_borderline(self, text: Column) -> Column:
        return borderline(text)


def detector(kind: str | None = "", entities: str | None = None, recognizer: Callable | None = None) -> Detector:
    """The detector of a configured kind: '', native or regex; presidio takes a recognizer, or else a column of entities."""
    if kind in (None, "", "native", "regex"):
        return Detector()
    if kind == "presidio":
        return Detector(recognizer=recognizer) if recognizer else Detector(entities or "entities")
    raise ValueError(f"unknown detector: {kind}")
