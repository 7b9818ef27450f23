"""Regular expressions in Java's dialect, equal to their Unicode-aware Python forms."""

from __future__ import annotations

import re

# White space as Python's str.isspace knows it, inside a class.
SPACE = r"\s\x0b\x1c-\x1f\x85\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_BEFORE, _AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"

# What the checks look for.
HTML_TAG = r"(?<!\.)</?[a-zA-Z][^>]*>|<!--[^\n]*?-->"
CONTROL = r"[\p{Cc}&&[^\t\n\r]]"
LONG_BLANKS = r"[ \t]{3,}"
LONG_BREAKS = r"\n{4,}"
URL = rf"https?://[^{SPACE}<>\"')\]]+|www\.[^{SPACE}<>\"')\]]+"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PII = {
    "email": EMAIL,
    "phone_us": rf"(?:\+?1[-.{SPACE}]?)?\(?\p{{Nd}}{{3}}\)?[-.{SPACE}]?\p{{Nd}}{{3}}[-.{SPACE}]?\p{{Nd}}{{4}}",
    "phone_jp": r"0\p{Nd}{1,4}-\p{Nd}{1,4}-\p{Nd}{3,4}",
    "ssn": rf"{_BEFORE}\p{{Nd}}{{3}}-\p{{Nd}}{{2}}-\p{{Nd}}{{4}}{_AFTER}",
    "credit_card": rf"{_BEFORE}(?:\p{{Nd}}{{4}}[-{SPACE}]?){{3}}\p{{Nd}}{{4}}{_AFTER}",
    "ip_address": rf"{_BEFORE}(?:\p{{Nd}}{{1,3}}\.){{3}}\p{{Nd}}{{1,3}}{_AFTER}",
}
#: What a match needs of a text's runs of digits, one blank between them.
NOT_DIGITS = r"\P{Nd}++"
PII_DIGITS = {
    "phone_us": r"\p{Nd}{3} ?\p{Nd}{3} ?\p{Nd}{4}",
    "phone_jp": r"0\p{Nd}{1,4} \p{Nd}{1,4} \p{Nd}{3,4}",
    "ssn": r"\p{Nd}{3} \p{Nd}{2} \p{Nd}{4}",
    "credit_card": r"(?:\p{Nd}{4} ?){3}\p{Nd}{4}",
    "ip_address": r"(?:\p{Nd}{1,3} ){3}\p{Nd}{1,3}",
}
STRIP = rf"\A[{SPACE}]+|[{SPACE}]+\z"


def to_java(pattern: str) -> str:
    """A user's Python pattern in Java's dialect; a bad one raises ``re.error``.

    Outside classes the shorthands get their Unicode meaning, inside a class
    they get the members, and ``(?i)`` folds Unicode case.
    """
    re.compile(pattern)
    out, i, depth = [], 0, 0
    shorthand = {"d": r"\p{Nd}", "w": r"\p{L}\p{N}_", "s": SPACE}
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            n = pattern[i + 1]
            i += 2
            if n in shorthand:
                out.append(shorthand[n] if depth else f"[{shorthand[n]}]")
            elif n.lower() in shorthand and not depth:
                out.append(f"[^{shorthand[n.lower()]}]")
            elif n == "b" and not depth:
                word = r"[\p{L}\p{N}_]"
                out.append(rf"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))")
            elif n == "Z":
                out.append(r"\z")
            else:
                out.append("\\" + n)
            continue
        if c == "[":
            if depth:
                c = r"\["
            else:
                depth = 1
                out.append(c)
                i += 1
                if pattern[i : i + 1] == "^":
                    out.append("^")
                    i += 1
                if pattern[i : i + 1] == "]":
                    out.append(r"\]")
                    i += 1
                continue
        elif c == "]" and depth:
            depth = 0
        elif c == "." and not depth:
            c = r"[^\n]"
        elif c == "$" and not depth:
            c = r"(?=\n?\z)"
        elif c == "&" and depth:
            c = r"\&"
        out.append(c)
        i += 1
    return re.sub(r"\(\?i\)", "(?iu)", "".join(out))
