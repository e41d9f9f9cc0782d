"""Identities: who a write is bound to, and what a reader may see."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SOURCE_CLASSES = ("external_tool", "user_input", "agent_authored", "system")
UNKNOWN, HUMAN = "unknown", "human_authored"
ATTESTED, SHARED_SCOPE, SHARED_KEY, UNBOUND = "attested", "shared", "shared://", ""
_SPACE = r"[\t\n\x0B\f\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def trimmed(c: Column) -> Column:
    """Without Unicode white space at either end; null is empty."""
    return F.coalesce(F.regexp_replace(c, rf"\A{_SPACE}+|{_SPACE}+\z", ""), F.lit(""))


def source_class(raw: Column) -> Column:
    """One of the four classes, matched exactly, or unknown."""
    return F.when(raw.isin(*SOURCE_CLASSES), raw).otherwise(UNKNOWN)


def agent_authored(raw: Column) -> Column:
    """Whether repetition is looked at: everything but what says it is a person's."""
    return trimmed(raw) != HUMAN


def attested(tier: Column) -> Column:
    return trimmed(tier) == ATTESTED


def bound_key(spiffe_id: Column, tier: Column, scope: Column) -> Column:
    """The key that a write is bound to. The shared marker as a subject is forged and counts as none."""
    subject = trimmed(spiffe_id)
    return F.when(attested(tier) & (trimmed(scope) == SHARED_SCOPE), SHARED_KEY).when(attested(tier) & (subject != "") & (subject != SHARED_KEY), subject).otherwise(UNBOUND)


def reader_key(spiffe_id: Column, tier: Column) -> Column:
    return F.when(attested(tier), trimmed(spiffe_id)).otherwise(UNBOUND)


def visible_keys(spiffe_id: Column, tier: Column) -> Column:
    """Each key once: a reader named like the shared marker has one."""
    return F.array_distinct(F.array(reader_key(spiffe_id, tier), F.lit(SHARED_KEY)))
