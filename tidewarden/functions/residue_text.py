"""Texts in comparable form for residue: numbers, currency, words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number words, scales, and words that identify nothing.
UNITS = {"zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
SCALES = {"hundred": 100, "thousand": 1_000, "million": 1_000_000, "billion": 1_000_000_000}
STOP_WORDS = ("the", "and", "for", "with", "that", "this", "are", "was", "has", "have", "from", "you", "your", "his", "her", "our", "their", "but", "not", "all", "any", "can", "may", "will")
STRONG_BYTES, LEAST_TOKENS, OVERLAP = 8, 3, 0.7

_MAGNITUDE = r"\$?(\d+(?:\.\d+)?)[\t\n\f\r ]*([kmb])(?!\w)"
_WHITE = r"[\t\n\x0B\f\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"


def _map(values: dict[str, int]) -> str:
    return "map(" + ", ".join(f"'{k}', {v}L" for k, v in values.items()) + ")"


def number_words(s: Column) -> Column:
    """Runs of number words as digits; words are separated by single blanks."""
    words = F.filter(F.split(s, _WHITE), lambda t: t != "")
    units, scales = F.expr(_map(UNITS)), F.expr(_map(SCALES))
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("long").alias("now"), F.lit(0).cast("long").alias("sum"), F.lit(False).alias("run"))

    def step(acc: Column, word: Column) -> Column:
        w = F.btrim(word, F.lit(".,$%"))
        unit, scale = F.try_element_at(units, w), F.try_element_at(scales, w)
        one = F.when(acc["now"] == 0, 1).otherwise(acc["now"])
        is_number, glue = unit.isNotNull() | scale.isNotNull(), (w == "and") & acc["run"]
        ended = F.when(acc["run"], F.concat(acc["out"], F.array((acc["sum"] + acc["now"]).cast("string")))).otherwise(acc["out"])
        now = F.when(unit.isNotNull(), acc["now"] + unit).when(scale == 100, one * 100).when(glue, acc["now"]).otherwise(F.lit(0).cast("long"))
        total = F.when(unit.isNotNull() | (scale == 100) | glue, acc["sum"]).when(scale.isNotNull(), acc["sum"] + one * scale).otherwise(F.lit(0).cast("long"))
        return F.struct(F.when(is_number | glue, acc["out"]).otherwise(F.concat(ended, F.array(word))).alias("out"), now.cast("long").alias("now"), total.cast("long").alias("sum"), (is_number | glue).alias("run"))

    def finish(acc: Column) -> Column:
        return F.array_join(F.when(acc["run"], F.concat(acc["out"], F.array((acc["sum"] + acc["now"]).cast("string")))).otherwise(acc["out"]), " ")

    # Most texts have no number words; they need no fold.
    some = F.rlike(s, F.lit("(?<![a-z])(?:" + "|".join([*UNITS, *SCALES]) + ")(?![a-z])"))
    return F.when(some, F.aggregate(words, zero, step, finish)).otherwise(F.array_join(words, " "))


def magnitudes(s: Column) -> Column:
    """$5k as $5000 and so on; fractions of a unit are cut off."""
    pieces, whole = F.split(s, _MAGNITUDE, -1), F.regexp_extract_all(s, F.lit(_MAGNITUDE), F.lit(0))
    numbers, marks = F.regexp_extract_all(s, F.lit(_MAGNITUDE), F.lit(1)), F.regexp_extract_all(s, F.lit(_MAGNITUDE), F.lit(2))

    def value(i: Column) -> Column:
        scale = F.when(F.get(marks, i) == "k", 1e3).when(F.get(marks, i) == "m", 1e6).otherwise(1e9)
        return F.concat(F.when(F.startswith(F.get(whole, i), F.lit("$")), "$").otherwise(""), (F.get(numbers, i).cast("double") * scale).cast("long").cast("string"))

    out = F.array_join(F.transform(pieces, lambda piece, i: F.concat(piece, F.coalesce(value(i), F.lit("")))), "")
    return F.when(F.rlike(s, F.lit(_MAGNITUDE)), out).otherwise(s)


def normalized(s: Column) -> Column:
    s = number_words(F.lower(F.coalesce(s, F.lit(""))))
    s = F.regexp_replace(s, r"(?<=\d),(?=\d{3})", "")
    s = magnitudes(s)
    s = F.regexp_replace(s, r"[^\w$%.]+", " ")
    return F.trim(F.regexp_replace(s, r"[\t\n\f\r ]+", " "))


def distinctive(s: Column) -> Column:
    """Lower-case words that identify a text, in order, repeats included."""
    words = F.split(F.lower(F.regexp_replace(F.coalesce(s, F.lit("")), r"[^\w$%.]+", " ")), " ")
    words = F.transform(F.filter(words, lambda t: t != ""), lambda t: F.btrim(t, F.lit(".$%")))
    return F.filter(words, lambda t: ((F.octet_length(t) >= 3) | F.rlike(t, F.lit(r"\A[0-9]+\z"))) & ~t.isin(*STOP_WORDS))


def strong(t: Column) -> Column:
    return (F.octet_length(t) >= STRONG_BYTES) | F.rlike(t, F.lit("[0-9]"))


def longest(tokens: Column) -> Column:
    """The longest of some tokens, the first of equals; '' of none."""
    return F.aggregate(tokens, F.lit(""), lambda best, t: F.when(F.octet_length(t) > F.octet_length(best), t).otherwise(best))


def deletion_hash(key: Column, content: Column) -> Column:
    return F.sha2(F.concat(F.lit("delete"), F.char(F.lit(0)), key, F.char(F.lit(0)), F.coalesce(content, F.lit(""))).cast("binary"), 256)


def baseline_hash(content: Column) -> Column:
    return F.sha2(F.concat(F.lit("immutable"), F.char(F.lit(0)), content).cast("binary"), 256)
