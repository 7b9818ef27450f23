"""Repair of damaged text: encoding mix-ups, markup, control characters, white space."""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from collections import Counter
from functools import lru_cache
from html.entities import html5
from html.parser import HTMLParser
from itertools import product

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import patterns as P
from corpusloom.functions.text import strip


#: Single-byte code pages in which UTF-8 may have been read, likeliest first.
CODE_PAGES = (
    "cp1252", "latin-1", "cp1251", "cp1250", "cp1253", "cp1254", "cp1257", "iso-8859-2", "mac-roman", "cp437",
)
#: A reading must lower a text's cost by more than this, so that one doubtful pair changes nothing.
LEAST_GAIN = 1.2
#: States that a search looks at after its best, and runs of a text that are searched together.
PATIENCE = 3
TOGETHER = 64


class _Page:
    """A code page: the byte of each of its characters, and the character runs that read as UTF-8 in it."""

    def __init__(self, name: str) -> None:
        self.byte_of: dict[str, int] = {}
        for b in range(0x80, 0x100):
            try:
                self.byte_of[bytes([b]).decode(name)] = b
            except UnicodeDecodeError:
                pass
        for b in range(0x80, 0x100):  # undefined bytes were read as the control of their number
            if b not in self.byte_of.values() or name == "cp1252":
                self.byte_of.setdefault(chr(b), b)

        def members(low: int, high: int) -> str:
            return "".join(re.escape(c) for c, b in self.byte_of.items() if low <= b <= high)

        trail = members(0x80, 0xBF)
        self.garbled = re.compile(
            f"[{members(0xC2, 0xDF)}][{trail}]|[{members(0xE0, 0xEF)}][{trail}]{{2}}|[{members(0xF0, 0xF4)}][{trail}]{{3}}"
        )

    def read(self, run: str) -> str:
        """What a run of characters was in UTF-8; the run itself where it is not valid."""
        try:
            return bytes(self.byte_of[c] for c in run).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            return run


_PAGES = [_Page(name) for name in CODE_PAGES]
_PUNCTUATION = set("\u2018\u2019\u201c\u201d\u201a\u201e\u2013\u2014\u2026\u2022\u2039\u203a\u20ac\u2122\u3000\u3001\u3002\u00ab\u00bb\u00a1\u00bf\u00a3\u00a7\u00a9\u00ae\u00b0\u00b7\u00a0")
#: Marks that seldom follow a letter at once.
_AFTER_BLANK = set("\u201c\u201e\u201a\u00a1\u00bf\u00ab\u20ac\u00a3\u00a9\u00ae\u2122\u00b0\u00a7\u00a0")
_USUAL = ("LATIN", "CYRILLIC", "GREEK", "CJK", "HIRAGANA", "KATAKANA", "HANGUL", "HEBREW", "ARABIC", "DEVANAGARI", "THAI")
_EAST = {"CJK", "HIRAGANA", "KATAKANA", "HANGUL"}


@lru_cache(maxsize=65_536)
def _kind(c: str) -> tuple[float, str, str]:
    """How implausible a character is, its script if it is a letter, and its case or class."""
    if c < "\x80":
        return 0.0, "LATIN" if c.isalpha() else "", "u" if c.isupper() else "l" if c.isalpha() else ""
    if c in "\u0192\u02c6\u02dc":  # signs of code pages, not letters
        return 1.0, "", "symbol"
    cat = unicodedata.category(c)
    if c in _PUNCTUATION:
        return 1.0, "", "after" if c in _AFTER_BLANK else ""
    if cat == "Cc":
        return 4.0, "", ""
    if cat in ("Cn", "Co", "Cf", "Cs") or c == "\ufffd":
        return 5.0, "", ""
    if cat[0] == "M":
        return 2.0, "", ""
    if cat[0] != "L" or c in "\u00aa\u00ba":
        return 1.0 if c >= "\U0001f000" else 2.5 if "\u2500" <= c <= "\u25ff" else 2.0, "", "symbol"
    script = unicodedata.name(c, "").split(" ")[0].split("-")[0]
    if script not in _USUAL:
        return 3.0, script, ""
    rare = "\u0180" <= c <= "\u02af" or "\u0460" <= c <= "\u0489" or "\u048a" <= c <= "\u052f"
    cost = 2.5 if rare else 1.5 if c in "\u00c2\u00c3\u00e2" else 1.0
    if script == "LATIN" and cost == 1.0 and c < "\u0180":  # letters of living languages; several in a row are a word
        cost = 0.3 if cat == "Ll" and c < "\u0100" else 0.6
    return cost, script, "u" if cat == "Lu" else "l" if cat == "Ll" else ""


@lru_cache(maxsize=131_072)
def implausibility(text: str) -> float:
    """A cost that is high for sequences that no one writes."""
    total, before = 0.0, ("", "")
    for c in text:
        cost, script, form = _kind(c)
        total += cost
        if before[0] and script and before[0] != script and not (before[0] in _EAST and script in _EAST):
            total += 3.0
        elif before[1] == "l" and form == "u":
            total += 1.0
        elif form in ("after", "symbol") and before[0] or script and before[1] == "symbol":
            total += 0.5
        before = script, form
    return total


Run = tuple[str, str, str]


@lru_cache(maxsize=131_072)
def _living(text: str) -> bool:
    """Whether a text has nothing but Latin letters of living languages."""
    return all(cost <= 0.6 and script == "LATIN" for cost, script, _ in map(_kind, text))


@lru_cache(maxsize=131_072)
def _reading_cost(old: Run, new: Run) -> float:
    """The cost of a run that was another before a page was read.

    Letters that people write are no evidence for another script, however often
    they occur: a few accented capitals in a row are a rare ideograph in one page.
    Where other runs tell that page, these are read with them.
    """
    cost = implausibility("".join(new))
    if new[1] != old[1] and _living(old[1]) and not _living(new[1]):
        return max(cost, implausibility("".join(old)))
    return cost


def _step(page: _Page, run: Run, whole: bool) -> Run:
    """A run of characters beyond ASCII, between its neighbours, read by a page.

    Either the run as a whole, where that is valid UTF-8, or the more plausible of
    that and of each sequence in it read for which that is no worse.
    """
    left, text, right = run
    plain_whole = page.read(text)
    if whole and plain_whole != text:
        return left, plain_whole, right
    at = 0
    while m := page.garbled.search(text, at):
        plain = page.read(m[0])
        new = text[: m.start()] + plain + text[m.end() :]
        a, b = max(0, m.start() - 1), m.end() + 1
        old_part = (left if m.start() == 0 else "") + text[a:b] + (right if b > len(text) else "")
        new_part = (left if m.start() == 0 else "") + text[a : m.start()] + plain + text[m.end() : b] + (right if b > len(text) else "")
        if plain != m[0] and implausibility(new_part) <= implausibility(old_part):
            text, at = new, m.start() + len(plain)
        else:
            at = m.start() + 1
    if plain_whole != run[1] and implausibility(left + plain_whole + right) < implausibility(left + text + right):
        text = plain_whole
    return left, text, right


#: Readings of a run: by a page, as a whole or in parts.
_READINGS = tuple(product(range(len(_PAGES)), (True, False)))


@lru_cache(maxsize=131_072)
def _readers(text: str) -> tuple[int, ...]:
    """The pages in which a run of characters has a sequence that reads as UTF-8; no other page changes it."""
    return tuple(k for k, p in enumerate(_PAGES) if p.garbled.search(text))


def _beside(c: str) -> str:
    """A letter that stands for all neighbours that count alike: ASCII's capitals, its small letters, or nothing for the rest."""
    return ("A" if c.isupper() else "a" if c.isalpha() else "") if c.isascii() else c


@lru_cache(maxsize=131_072)
def _moves(run: Run) -> tuple[float, dict[int, tuple[str, float]]]:
    """The cost of a run as it is, and the readings that change it: what it becomes and costs then."""
    moves = {}
    for page in _readers(run[1]):
        for k in (2 * page, 2 * page + 1):
            new = _step(_PAGES[page], run, _READINGS[k][1])
            if new != run:
                moves[k] = new[1], _reading_cost(run, new)
    return _reading_cost(run, run), moves


def ungarble(runs: dict[Run, int]) -> dict[Run, Run]:
    """The plausible reading of runs of characters, each with its neighbours and how often it occurs.

    Best-first search over chains of code pages: a state is what all the runs
    have become, its successors are the readings by one more page, and the least
    implausible state is taken up first.  The search ends when ``PATIENCE`` states
    in a row gave nothing better than the best.  Each reading is shorter than what
    it reads, so chains end by themselves; there is no bound on their length.
    Only the pages that change a run are tried on it.
    """
    sides = [(_beside(left), _beside(right)) for left, _, right in runs]
    often = list(runs.values())
    start = tuple(text for _, text, _ in runs)

    def options(state: tuple[str, ...]) -> list[tuple[float, dict[int, tuple[str, float]]]]:
        return [_moves((left, text, right)) for (left, right), text in zip(sides, state)]

    best, since = start, 0
    best_cost = sum(n * cost for n, (cost, _) in zip(often, options(start)))
    queue, seen = [(best_cost, 0, start)], {start}
    while queue and since < PATIENCE:
        now, _, state = heapq.heappop(queue)
        since += 1
        if now < best_cost - LEAST_GAIN:
            best, best_cost, since = state, now, 0
        own = options(state)
        costs = [n * cost for n, (cost, _) in zip(often, own)]
        changed: dict[int, list[int]] = {}
        for i, (_, moves) in enumerate(own):
            for k in moves:
                changed.setdefault(k, []).append(i)
        for k in sorted(changed):
            texts, new_costs = list(state), costs.copy()
            for i in changed[k]:
                texts[i], cost = own[i][1][k]
                new_costs[i] = often[i] * cost
            new = tuple(texts)
            if new not in seen:
                seen.add(new)
                new_cost = sum(new_costs)
                if new_cost < now - LEAST_GAIN:
                    heapq.heappush(queue, (new_cost, len(seen), new))
    return {run: (run[0], text, run[2]) for run, text in zip(runs, best)}


_BEYOND_ASCII = re.compile("[^\x00-\x7f]{2,}")  # one character alone is never a garbled one


def _readable(text: str) -> str:
    """A text with its garbled characters read as what they were, until nothing improves.

    The runs of a text are taken up ``TOGETHER`` at a time, the most frequent first.
    """
    while True:
        places = [
            (m.start(), m.end(), (text[m.start() - 1 : m.start()], m[0], text[m.end() : m.end() + 1]))
            for m in _BEYOND_ASCII.finditer(text)
            if _readers(m[0])
        ]
        runs = Counter(run for _, _, run in places).most_common()
        plain: dict[Run, Run] = {}
        for at in range(0, len(runs), TOGETHER):
            plain |= ungarble(dict(runs[at : at + TOGETHER]))
        if all(new == run for run, new in plain.items()):
            return text
        out, at = [], 0
        for a, b, run in places:
            out += [text[at:a], plain[run][1]]
            at = b
        text = "".join([*out, text[at:]])


_ESCAPES = re.compile(r"\x1b\[[0-9;]*[A-Za-z]")
_DROPPED = re.compile("[\x00-\x08\x0b\x0e-\x1f\x7f\u206a-\u206f\ufeff\ufff9-\ufffc]")
_BREAKS = re.compile("\r\n|\r|\x85|\u2028|\u2029")
_LIGATURES = re.compile("[\ufb00-\ufb06]")
_WIDE = re.compile("[\uff01-\uff9f\uffa0-\uffdc\uffe0-\uffe6]")
_QUOTES = {c: "'" for c in "\u2018\u2019\u201a\u201b"} | {c: '"' for c in "\u201c\u201d\u201e\u201f"} | {"\u3000": " "}
_QUOTED = re.compile(f"[{''.join(_QUOTES)}]")
_C1 = {chr(b): bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


#: References as they are written out, and what may be one by its name alone.
_REFERENCE = re.compile("&#?[0-9A-Za-z]+;")
_NAMED = re.compile(r"&([A-Za-z]\w*;?)")


def _decoded(reference: re.Match) -> str:
    """A reference's character; the reference itself where only the start of its name is known."""
    return html.unescape(reference[0]) if reference[0][1] == "#" or reference[0][1:] in html5 else reference[0]


def _whole_names(name: re.Match) -> str:
    """A name, its ampersand escaped where only the start of it is known: a word that follows an ampersand is no reference."""
    return name[0] if name[1] in html5 else "&amp;" + name[1]


def fix_text(text: str) -> str:
    """Text with its encoding damage undone and its odd characters made plain."""
    if text.isascii() and "&" not in text and "\r" not in text and not _DROPPED.search(text):
        return text
    if "&" in text and "<" not in text:
        text = _REFERENCE.sub(_decoded, text)
    text = _ESCAPES.sub("", text)
    text = _readable(text)
    text = re.sub("[\x80-\x84\x86-\x9f]", lambda m: _C1.get(m[0], m[0]), text)
    text = _LIGATURES.sub(lambda m: unicodedata.normalize("NFKC", m[0]), text)
    text = _WIDE.sub(lambda m: unicodedata.normalize("NFKC", m[0]), text)
    text = _BREAKS.sub("\n", _QUOTED.sub(lambda m: _QUOTES[m[0]], text))
    return unicodedata.normalize("NFC", _DROPPED.sub("", text))


class _Stripper(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style") and self.hidden:
            self.hidden -= 1

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)


def strip_markup(text: str) -> str:
    """Text of a markup string: tags, comments, scripts and styles go, references are decoded."""
    if "<" not in text and "&" not in text:
        return text
    parser = _Stripper()
    parser.feed(_NAMED.sub(_whole_names, text))
    parser.close()
    return "".join(parser.parts)


def _each(function):  # noqa: ANN001, ANN202
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else function(t) for t in texts.to_pylist()], type=pa.string())

    return F.arrow_udf(run, "string")


def _guarded(text: Column, may_change: Column, function) -> Column:  # noqa: ANN001
    """Apply a Python function only where a JVM test says that it may change the text."""
    return F.coalesce(_each(function)(F.when(may_change, text)), text)


#: What a text must have for repair to change it.
_MAY_CHANGE = r"[^\x09\x0A\x20-\x7E]|&"


def fix_mojibake(text: Column) -> Column:
    return _guarded(text, text.rlike(_MAY_CHANGE), fix_text)


def _or_same(function):  # noqa: ANN001, ANN202
    """The function, with the text itself where it fails: such a row is passed over, and leaves the others alone."""

    def run(text: str) -> str:
        try:
            return function(text)
        except Exception:  # noqa: BLE001
            return text

    return run


def has_mojibake(text: Column) -> Column:
    """Whether repair would change a text; never null, and false where repair fails."""
    return F.coalesce(_guarded(text, text.rlike(_MAY_CHANGE), _or_same(fix_text)) != text, F.lit(False))


def strip_html(text: Column) -> Column:
    return _guarded(text, text.rlike("[<&]"), strip_markup)


def remove_control_chars(text: Column) -> Column:
    return F.regexp_replace(text, P.CONTROL, "")


def normalize_whitespace(text: Column) -> Column:
    shorter = F.regexp_replace(F.regexp_replace(text, P.LONG_BLANKS, "  "), P.LONG_BREAKS, "\n\n\n")
    return strip(shorter)
