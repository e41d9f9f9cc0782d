"""Screening of writes: detectors, key policy, rolling inspectors, routing.

A write log has columns seq (total order), secs (seconds, not falling with seq), content, spiffe_id, trust_tier, scope,
source and key. Each step adds columns; rows that an earlier step rejected take no part in later state.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewarden.functions import detect, identity, patterns
from tidewarden.functions.residue_text import baseline_hash
from tidewarden.operators import inspectors, rolling
from tidewarden.sources.shared import written

PROTECTED_FLAG, IMMUTABLE_FLAG = "protected_key_violation", "immutable_mismatch"
SIZE_FLAG, REPEAT_FLAG = "size_anomaly_suspected", "self_reinforcement_suspected"


@dataclass(frozen=True)
class SizeAnomaly:
    """A write is odd if its bytes are over `sigma` deviations from the mean of its key's last `window` writes."""

    window: int = 20
    sigma: float = 3.0
    least: int = 5

    def __post_init__(self):
        for name, default in (("window", 20), ("sigma", 3.0), ("least", 5)):
            if getattr(self, name) <= 0:
                object.__setattr__(self, name, default)

    def flag(self, key: str | list[str], order: str, size: str) -> Column:
        w = Window.partitionBy(key).orderBy(order).rowsBetween(-self.window, -1)
        x = F.col(size).cast("decimal(14,0)")
        n = F.count(F.lit(1)).over(w)
        s, q = F.sum(x).over(w), F.sum(x * x).over(w)
        # (n x - s)^2 > sigma^2 (n q - s^2) is exact where a float deviation may differ at the boundary.
        left = F.pow((n * x - s).cast("double"), F.lit(2.0))
        return F.when((n >= self.least) & (left > self.sigma * self.sigma * (n * q - s * s).cast("double")), SIZE_FLAG)


@dataclass(frozen=True)
class SelfReinforcement:
    """A write is repetitive if `most` of its key's recent writes share `similarity` of the smaller set of words."""

    similarity: float = 0.85
    cooldown: int = 300
    most: int = 3
    history: int = 256

    @staticmethod
    def tokens(content: Column) -> Column:
        # The same words as extracting [a-z0-9]+, by a class spelled out.
        return F.array_distinct(F.array_remove(F.split(F.lower(content), "[^abcdefghijklmnopqrstuvwxyz0123456789]+"), ""))


@dataclass(frozen=True)
class Policy:
    """Globs of protected and immutable keys, the reserved prefix, and the inspectors that run, in order of their flags."""

    protected: tuple[str, ...] = ()
    immutable: tuple[str, ...] = ()
    reserved: str = "guard:"
    size: SizeAnomaly | None = field(default_factory=SizeAnomaly)
    repeats: SelfReinforcement | None = field(default_factory=SelfReinforcement)
    detector: detect.Detector = field(default_factory=detect.Detector)
    more: tuple[inspectors.Lookback, ...] = ()


def detected(log: DataFrame, policy: Policy) -> DataFrame:
    """redacted, pii_flags, injection, borderline, source_class, bound_key, is_attested. One pass, no shuffle."""
    return classed(policy.detector.redact(log.withColumn("content", F.coalesce("content", F.lit(""))), "content"), policy)


def classed(log: DataFrame, policy: Policy) -> DataFrame:
    """injection, borderline, source_class, bound_key and is_attested: what detected() adds besides the redaction."""
    return (
        log.withColumn("injection", policy.detector.detect_injection(F.col("content")))
        .withColumn("borderline", policy.detector.detect_borderline(F.col("content")))
        .withColumn("source_class", identity.source_class(F.col("source")))
        .withColumn("bound_key", identity.bound_key(F.col("spiffe_id"), F.col("trust_tier"), F.col("scope")))
        .withColumn("is_attested", F.coalesce(identity.attested(F.col("trust_tier")), F.lit(False)))
    )


def _any(globs: tuple[str, ...], key: Column) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | F.rlike(key, F.lit(patterns.glob(g)))
    return out


def key_marks(rows: DataFrame, policy: Policy) -> DataFrame:
    """_reserved, _violates and _pinned: what the key alone decides, and whether the row pins or is compared with a baseline."""
    key = F.coalesce(F.col("key"), F.lit(""))
    named = key != ""
    reserved = named & F.startswith(key, F.lit(policy.reserved))
    rows = rows.withColumn("_reserved", reserved)
    rows = rows.withColumn("_violates", named & (reserved | _any(policy.protected, key)) & ~F.col("is_attested"))
    return rows.withColumn("_pinned", named & (reserved | _any(policy.immutable, key)) & ~F.col("injection") & ~(reserved & F.col("_violates")))


def key_flags(rows: DataFrame, differs: Column) -> DataFrame:
    """key_flag_1, key_flag_2 and key_rejected of rows with key_marks(); differs: from the key's baseline (null: not compared)."""
    flag_1 = F.when(F.col("_violates"), PROTECTED_FLAG)
    flag_2 = F.when(differs, IMMUTABLE_FLAG)
    live = ~F.col("injection")
    return rows.withColumn("key_flag_1", F.when(live, flag_1)).withColumn("key_flag_2", F.when(live, flag_2)).withColumn("key_rejected", live & F.col("_reserved") & (F.col("_violates") | F.coalesce(differs, F.lit(False)))).drop("_reserved", "_violates", "_pinned")


def differing(rows: DataFrame) -> DataFrame:
    """seq of rows with key_marks() whose hash is another than their key's first. Only keys and hashes of pinned rows move."""
    key = F.coalesce(F.col("key"), F.lit("")).alias("key")
    pinned = rows.where("_pinned").select("seq", key, (F.col("h") if "h" in rows.columns else baseline_hash(F.col("redacted"))).alias("h"))
    first = pinned.groupBy("key").agg(F.min_by("h", "seq").alias("baseline"))
    return pinned.join(first, "key").where("h <> baseline").select("seq")


def keyed(rows: DataFrame, policy: Policy) -> DataFrame:
    """key_flag_1, key_flag_2 and key_rejected. Baselines are those of rows that passed detection."""
    rows = key_marks(rows, policy)
    rows = rows.join(differing(rows).withColumn("_differs", F.lit(True)), "seq", "left")
    return key_flags(rows, F.col("_pinned") & F.coalesce("_differs", F.lit(False))).drop("_differs")


def measured(rows: DataFrame, policy: Policy) -> DataFrame:
    """bytes, agent, words and more: what the rolling checks and plugged-in inspectors need to know of a write."""
    agent = identity.agent_authored(F.col("source"))
    none = F.array().cast("array<string>")
    words = F.when(agent, policy.repeats.tokens(F.col("content"))).otherwise(none) if policy.repeats else none
    return rows.withColumns({"bytes": F.octet_length("content").cast("long"), "agent": agent, "words": words, "more": inspectors.known(policy.more)})


def inspections(passed: DataFrame, policy: Policy, part: int = rolling.PART) -> DataFrame:
    """seq, size_flag, repeat_flag and more_flags of the flagged rows of some with measured(), by seq within each bound key.

    Keys are cut into parts of bounded size (see rolling); only seq, sizes, word sets and instants move. secs must not fall with
    seq among a key's agent-authored rows: that is an error, here as in the stream.
    """
    found = [passed.sparkSession.createDataFrame([], "seq long, place int, flag string")]
    if policy.size:
        sizes = rolling.flagged_sizes(passed.select("seq", "bound_key", "bytes"), "bound_key", "seq", policy.size.flag(["bound_key", "part"], "pos", "bytes"), policy.size.window, part)
        found.append(sizes.select(F.col("seq").cast("long").alias("seq"), F.lit(-2).alias("place"), F.lit(SIZE_FLAG).alias("flag")))
    if policy.repeats:
        r = policy.repeats
        again = rolling.repeated(passed.where("agent").select(F.col("seq").cast("long").alias("seq"), F.col("secs").cast("long").alias("secs"), "bound_key", "words"), "bound_key", r.similarity, r.cooldown, r.most, r.history, part)
        found.append(again.select("seq", F.lit(-1).alias("place"), F.lit(REPEAT_FLAG).alias("flag")))
    for k, inspector in enumerate(policy.more):
        found.append(inspectors.flagged(passed, inspector, k, part).select("seq", F.lit(k).alias("place"), F.lit(inspector.flag).alias("flag")))
    all_ = found[0]
    for f in found[1:]:
        all_ = all_.unionByName(f)
    others = F.transform(F.array_sort(F.collect_list(F.when(F.col("place") >= 0, F.struct("place", "flag")))), lambda x: x["flag"])
    return all_.groupBy("seq").agg(F.max(F.when(F.col("place") == -2, F.col("flag"))).alias("size_flag"), F.max(F.when(F.col("place") == -1, F.col("flag"))).alias("repeat_flag"), others.alias("more_flags"))


def inspected(rows: DataFrame, policy: Policy) -> DataFrame:
    """rows with size_flag and repeat_flag, from those that were not rejected."""
    passed = rows.where(~F.col("injection") & ~F.col("key_rejected"))
    passed = passed if "words" in rows.columns else measured(passed, policy)
    slim = written(passed.select("seq", "secs", "bound_key", "bytes", "agent", "words", "more"), "passed")
    return rows.join(inspections(slim, policy), "seq", "left")


def routed(rows: DataFrame) -> DataFrame:
    """allow, state, flags (in order) and stored_id. Ids follow from seq, so a run can be repeated."""
    text = lambda name, flag: F.when(F.col(name), flag)
    listed = F.concat(F.array(text("injection", detect.INJECTION_FLAG)), F.col("pii_flags"), F.array(text("borderline", detect.BORDERLINE_FLAG)))
    plugged = F.coalesce("more_flags", F.array().cast("array<string>")) if "more_flags" in rows.columns else F.array().cast("array<string>")
    rolling_flags = F.array_distinct(F.concat(F.array("size_flag", "repeat_flag"), plugged))
    kept = F.when(F.col("injection"), listed).when(F.col("key_rejected"), F.concat(listed, F.array(F.coalesce("key_flag_1", "key_flag_2")))).otherwise(F.concat(listed, F.array("key_flag_1", "key_flag_2"), rolling_flags))
    state = F.when(F.col("injection") | F.col("key_rejected"), "block").when(F.col("borderline"), "quarantine").otherwise("allow")
    rows = rows.withColumn("flags", F.filter(kept, lambda f: f.isNotNull())).withColumn("state", state).withColumn("allow", F.col("state") != "block")
    return rows.withColumn("stored_id", F.when(F.col("allow"), F.concat(F.lit("mem-"), F.substring(F.sha2(F.col("seq").cast("string").cast("binary"), 256), 1, 12))))


def screened(log: DataFrame, policy: Policy, measure: bool = True, redact: Column | None = None, text: bool = True) -> DataFrame:
    """detected() with key_marks() and measured() as a written table without the raw content, so that detection runs once.

    measure: False where no rolling check follows. redact: the rows whose text or flags of redaction a later step reads (None: all);
    others have an empty text, unless a key's baseline needs theirs. text: False where no later step reads a redacted text.
    """
    if redact is None:
        rows = key_marks(detected(log, policy), policy)
    else:
        rows = key_marks(classed(log.withColumn("content", F.coalesce("content", F.lit(""))), policy), policy)
        rows = policy.detector.redact(rows.withColumn("_read", F.when(redact | F.col("_pinned"), F.col("content"))), "_read").drop("_read")
    rows = measured(rows, policy) if measure else rows
    rows = rows.withColumn("h", F.when(F.col("_pinned"), baseline_hash(F.col("redacted")))).drop("content")
    return written(rows if text else rows.drop("redacted"), "detected")


def keyed_text(rows: DataFrame) -> DataFrame:
    """keyed() of screened rows, with empty flags of the rolling checks, which don't decide routing."""
    none = F.lit(None).cast("string")
    # Written, Spark knows that it is small, and shuffles no text to join it.
    differs = written(differing(rows).withColumn("_differs", F.lit(True)), "differing")
    rows = rows.join(differs, "seq", "left")
    return key_flags(rows, F.col("_pinned") & F.coalesce("_differs", F.lit(False))).drop("_differs").withColumns({"size_flag": none, "repeat_flag": none})


def validate_writes(log: DataFrame, policy: Policy, redact: Column | None = None, text: bool = True) -> DataFrame:
    """Verdicts of all writes. The steps find the few rows that they flag, by columns without text; the rows are joined once.

    redact and text: as in screened(). What is flagged is written, so that Spark knows that it is small and no text is shuffled.
    """
    rows = screened(log, policy, redact=redact, text=text)
    differs = written(differing(rows).withColumn("differs", F.lit(True)), "differing")
    marks = rows.select("seq", "secs", "bound_key", "bytes", "agent", "words", "more", "injection", "_reserved", "_violates", "_pinned").join(differs, "seq", "left")
    live = key_flags(marks, F.col("_pinned") & F.coalesce("differs", F.lit(False))).where(~F.col("injection") & ~F.col("key_rejected"))
    flags = inspections(live.select("seq", "secs", "bound_key", "bytes", "agent", "words", "more"), policy)
    flags = written(flags.join(differs.withColumnRenamed("differs", "_differs"), "seq", "full"), "flagged")
    rows = rows.join(flags, "seq", "left")
    return routed(key_flags(rows, F.col("_pinned") & F.coalesce("_differs", F.lit(False))).drop("_differs"))
