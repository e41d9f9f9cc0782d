"""Regular expressions of the detectors.

Patterns are written for RE2 semantics (ASCII classes, Unicode case folding). Java's word boundary and white space
differ, so java() rewrites them; DuckDB runs the originals.
"""

from __future__ import annotations

import re

# Labels and patterns, in the order in which they are applied.
PII = (
    ("EMAIL", r"[\w.+-]+@[\w-]+\.[\w.-]+"),
    ("US_SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("CREDIT_CARD", r"\b(?:\d[ -]?){13,16}\b"),
    ("API_KEY", r"\b(?:sk-ant|sk|AKIA|ghp|xox[baprs]|hf_|npm_|pat_|xp_)[-_A-Za-z0-9]{8,}"),
    ("PHONE", r"\b(?:\+1[\s.-]?)?\(?\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}\b"),
    ("IBAN", r"\b[A-Z]{2}\d{2}[A-Z0-9]{4,30}\b"),
    ("IP_ADDRESS", r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b|(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){1,7}:|::(?:[0-9a-fA-F]{1,4}:){0,6}[0-9a-fA-F]{1,4}"),
    ("DOB", r"\b(?:0?[1-9]|1[0-2])/(?:0?[1-9]|[12]\d|3[01])/(?:19|20)\d{2}\b|\b(?:19|20)\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])\b|\b(?:0?[1-9]|[12]\d|3[01])\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+(?:19|20)\d{2}\b"),
    ("CREDENTIAL", r"\b[0-9a-fA-F]{32,}\b"),
)
INJECTION = (
    r"(?i)ignore\b[\w\s]*\binstructions",
    r"(?i)disregard\b[\w\s]*\binstructions",
    r"(?i)system prompt",
    r"(?i)</?(?:system|instructions)>",
    r"(?i)\[INJECT[:\s]",
    r"(?i)\bunrestricted\s+(?:ai|assistant|model|llm|chatbot|gpt|bot)\b",
)
#: Classes spelled out: Java looks a letter up in a listed class, but asks one range of a class after the other.
_DIGIT, _UPPER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_HEX, _BASE64 = f"[{_DIGIT}abcdefABCDEF]", f"[{_UPPER}{_UPPER.lower()}{_DIGIT}+/]"
#: What every match of a recognizer has in it, as texts, then as one pattern: cheap to look for, and most texts have neither.
NEEDS = {
    "EMAIL": (("@",), None),
    "US_SSN": ((), r"[0-9]-[0-9]{2}-[0-9]{4}"),
    "CREDIT_CARD": ((), r"[0-9][ -]?(?:[0-9][ -]?){12}"),
    "API_KEY": (("sk", "AKIA", "ghp", "xox", "hf_", "npm_", "pat_", "xp_"), None),
    "PHONE": ((), r"[0-9]\)?[\t\n\f\r .-][0-9]{3}[\t\n\f\r .-][0-9]{4}"),
    "IBAN": ((), rf"[A-Z][0-9]{{2}}[{_UPPER}{_DIGIT}]{{4}}"),
    "IP_ADDRESS": (("::",), rf"[0-9]\.[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]|:{_HEX}{{1,4}}:{_HEX}{{1,4}}:"),
    "DOB": ((), r"(?:19|20)[0-9]{2}"),
    "CREDENTIAL": ((), rf"{_HEX}{{32}}"),
}
#: The same of injection and borderline phrases. Letters that fold with others than ASCII ones (i, k, s) are left out.
INJECTION_NEEDS = r"[gG][nN][oO][rR][eE]|[rR][eE][gG][aA][rR][dD]|[eE][mM] [pP][rR][oO][mM][pP][tT]|[<\[]|[uU][nN][rR][eE]"
BORDERLINE_NEEDS = r"[pP][rR][eE][tT][eE][nN][dD]"
#: BASE64_RUN for Java, and what it needs: 16 letters of it.
BASE64_JAVA, BASE64_NEEDS = rf"{_BASE64}{{16,}}+={{0,2}}", rf"{_BASE64}{{16}}"
BORDERLINE = r"(?i)pretend\s+(?:the\s+above|this)\s+never\s+happened"
BASE64_RUN = r"[A-Za-z0-9+/]{16,}={0,2}"
#: Bytes of a text and base64 runs that are decoded.
DECODE_BYTES, DECODE_RUNS = 16_384, 32

SPACE = r"[\t\n\f\r ]"
BEFORE_WORD, AFTER_WORD = r"(?<!\w)", r"(?!\w)"
BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def java(pattern: str) -> str:
    """The pattern for Java: ASCII word boundaries, RE2's white space, and Unicode folding under (?i)."""
    p = pattern.replace("(?i)", "(?iu)")
    p = re.sub(r"\[([^\]]*)\\s([^\]]*)\]", r"[\1\\t\\n\\f\\r \2]", p).replace(r"\s", SPACE)
    out, at = [], 0
    for m in re.finditer(r"\\b", p):
        before, after = p[: m.start()], p[m.end() :]
        # One-sided where the neighbour is always a word character; general elsewhere.
        if _starts_word(after):
            b = BEFORE_WORD
        elif _ends_word(before):
            b = AFTER_WORD
        else:
            b = BOUNDARY
        out += [p[at : m.start()], b]
        at = m.end()
    return "".join([*out, p[at:]])


def _starts_word(after: str) -> bool:
    """Whether what follows a boundary always begins with a word character."""
    return bool(re.match(r"\\d|\[(?:0-9a-fA-F|A-Z)\]|\(\?:(?:\\d|sk-ant|\(\?:25|0\?\[1-9\]|19)|unrestricted|instructions", after))


def _ends_word(before: str) -> bool:
    """Whether what stands before a boundary always ends with a word character."""
    return bool(re.search(r"(?:\\d\{\d\}|\\d\\d\?\)|3\[01\]\)|\{4,30\}|\{32,\}|gpt\|bot\)|ignore|disregard)$", before))


def _member(pattern: str, i: int) -> tuple[str, int]:
    """A character of a class, escaped or not, and where the pattern goes on after it."""
    if i < len(pattern) and pattern[i] not in "-]":
        i += pattern[i] == "\\"
        if i + 1 < len(pattern):  # what ends a pattern can't be in a class
            return pattern[i], i + 1
    raise ValueError(f"malformed pattern: {pattern}")


def glob(pattern: str) -> str:
    """An anchored regular expression of a path glob: * and ? stop at /, classes and escapes as in path matching.

    A class is one or more characters and ranges; a range whose ends are in falling order matches nothing.
    """
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            negated = pattern[i : i + 1] == "^"
            i += negated
            body, some = [], False
            while not (some and pattern[i : i + 1] == "]"):
                low, i = _member(pattern, i)
                high = low
                if pattern[i : i + 1] == "-":
                    high, i = _member(pattern, i + 1)
                some = True
                if low <= high:
                    body.append(f"{re.escape(low)}-{re.escape(high)}")
            i += 1
            none, every = r"[^\s\S]", r"[\s\S]"
            out.append(f"[{'^' * negated}{''.join(body)}]" if body else every if negated else none)
        elif c == "\\":
            if i >= len(pattern):
                raise ValueError(f"malformed pattern: {pattern}")
            out.append(re.escape(pattern[i]))
            i += 1
        else:
            out.append(re.escape(c))
    return r"\A(?s:" + "".join(out) + r")\z"


def pattern_list(text: str | None) -> tuple[str, ...]:
    """Globs of a comma-separated list; malformed ones are errors."""
    found = tuple(p for p in (x.strip() for x in (text or "").split(",")) if p)
    for p in found:
        glob(p)
    return found
