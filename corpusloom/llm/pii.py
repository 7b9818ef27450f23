"""Personal data by weak supervision.

1. Candidates.  A row-local Arrow function finds, in every whole text, the base
   spans (patterns with checks) and further candidates of wide, generic shapes:
   any digit group that the base rules leave out, any run of two or three
   capitalised words, a capitalised word after a title or an introduction, and
   codes in the shape of account numbers.
2. Votes.  Regex, gazetteer and context labelers each vote for, against, or
   abstain on every candidate.  Votes and a few features are packed in one
   small integer code.
3. Aggregation.  Spark counts the candidates of each code over all documents.
   There are at most ``N_CODES`` codes whatever the corpus, so that table, and
   nothing else, goes to the driver.
4. Expectation-maximisation on the counts estimates each labeler's reliability
   and each code's probability of being personal data.
5. A logistic span classifier is trained on those probabilities; a candidate is
   reported if it is a base span or if the classifier says so.

No shuffle moves texts.  The candidates are written once into the shared folder
(a few bytes a document), so the second step does not read the texts again.

Labelers disagree: a checksum that fails against a cue before the span, a date's
shape against ``born``, a name in the gazetteer at the start of a sentence.  How
far each is believed follows from the counts alone.  On the public tables every
candidate with a vote for it is a base span, so nothing is added there.

Defined cases: a null text is empty and has no spans; an empty table gives no
rows; repeated rows each get their own result; texts of any length are read
whole; with no candidates at all nothing is learned and nothing is added; added
spans never overlap a base span; order is by start, then kind as listed in
``KINDS``; further columns play no part, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import count_kind, give_back, span_list, table, text_of
from corpusloom.sources.session import fresh_name, materialise, ship_package

KINDS = ("email", "ip", "card", "phone", "number", "person", "account")
BASE_KINDS = KINDS[:4]
FOUND_TYPE = "array<struct<kind:string,start:int,end:int,base:boolean,code:int>>"
_ARROW = pa.list_(
    pa.struct(
        [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("code", pa.int32())]
    )
)

# The base patterns.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Candidates beyond the base.
_DIGIT = re.compile(r"[0-9]")
_GROUPS = re.compile(r"(?<![0-9A-Za-z_.-])\(?[0-9][0-9 ().-]{5,}[0-9](?![0-9A-Za-z_])")
_TITLES = ("Mr. ", "Mrs. ", "Ms. ", "Dr. ", "Prof. ", "Herr ", "Frau ", "Monsieur ", "Madame ", "Señor ", "Señora ")
_INTRODUCTIONS = ("my name is ", "My name is ", "name: ", "Name: ", "ich heiße ", "je m'appelle ", "me llamo ")
_NAME = re.compile(r"[A-ZÀ-Þ][a-zà-ÿ'-]+(?: [A-ZÀ-Þ][a-zà-ÿ'-]+){0,2}")
_NAMES = re.compile(r"(?<![A-Za-zÀ-ÿ0-9.'-])[A-ZÀ-Þ][a-zà-ÿ'-]+(?: [A-ZÀ-Þ][a-zà-ÿ'-]+){1,2}(?![A-Za-zÀ-ÿ])")
_ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")

# Gazetteers and cues of the labelers.
_GIVEN = frozenset(
    "James Mary John Patricia Robert Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph "
    "Jessica Thomas Sarah Charles Karen Hans Peter Klaus Jürgen Wolfgang Ursula Monika Petra Sabine Anna Jean Pierre "
    "Michel Marie Nathalie Isabelle Sophie Camille Antoine Luc José Carlos Juan Luis Javier Carmen Lucía Sofía "
    "Alejandro Miguel".split()
)
_CALLING_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 54 55 61 81 82 86 91".split())
_PHONE_SHAPE = re.compile(r"\(?[0-9]{2,5}\)?[ .-][0-9]{3,4}[ .-]?[0-9]{3,4}")
_ID_SHAPE = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
_NOT_SHAPE = re.compile(r"[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4}|[0-9]+\.[0-9]+|[0-9]{4} ?- ?[0-9]{4}")
_UNIT = re.compile(r"\s*(?:%|€|\$|£|kg|km|mm|cm|MB|GB|EUR|USD|bytes|pages|rows)")
_FOR = re.compile(
    r"(?i)\b(?:call|phone|tel|telephone|mobile|cell|fax|contact|sms|whatsapp|ssn|social security|passport|account|iban|"
    r"card|born|telefon|handy|téléphone|teléfono|móvil)\b"
)
_FOR_NAME = re.compile(r"(?i)\b(?:mr|mrs|ms|dr|prof|herr|frau|monsieur|madame|señora?|name|heiße|appelle|llamo)\b")
_AGAINST = re.compile(r"(?i)\b(?:version|isbn|issn|doi|page|pages|order|item|invoice|chapter|section|figure|rfc|id|build|commit)\b")

_NOT_NAME = re.compile(r"(?i)\b(?:the|der|die|das|den|dem|le|la|les|el|los|las|in|of|at|im|am|zu|de)\s+$")
_SENTENCE = re.compile(r"(?:^|[.!?:]\s+|[\"(|*-]\s*)$")

N_VOTES = 7
_N_FEATURES = len(KINDS) * 4 * 2
#: Every code is below this, so the table of counts has at most so many rows.
N_CODES = 3**N_VOTES * _N_FEATURES


def luhn(digits: str) -> bool:
    """Whether a digit string passes the Luhn check."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[int, int]]]:
    """Base spans of one text, and the spans that had a shape but failed its check."""
    out, failed = [], []
    at, low = text.find("@"), 0
    while at >= 0:
        head = text[low:at]
        start = low + len(head.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append(("email", start, m.end()))
        low = m.end() if m else at + 1
        at = text.find("@", low)
    if _DIGIT.search(text):
        if "." in text:
            for m in _IP.finditer(text):
                if all(len(d) <= 3 and int(d or "0") <= 255 for d in (p.lstrip("0") for p in m[0].split("."))):
                    out.append(("ip", *m.span()))
                else:
                    failed.append(m.span())
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = _only_digits(m[0])
                if 12 <= len(digits) <= 19:
                    if luhn(digits):
                        out.append(("card", *m.span()))
                    else:
                        failed.append(m.span())
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_only_digits(m[0])) <= 15:
                    out.append(("phone", *m.span()))
                else:
                    failed.append(m.span())
    return out, failed


def mod97(account: str) -> bool:
    """Whether an account number passes the check of remainder 1 modulo 97."""
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _code(text: str, kind: str, start: int, end: int, valid: int) -> int:
    """The votes of all labelers and a few features, as one integer."""
    span = text[start:end]
    digits = _only_digits(span)
    before = text[max(0, start - 24) : start].rpartition("\n")[2]
    numeric = kind not in ("person", "account")
    known = 0
    if kind == "person":
        known = 1 if span.split(" ", 1)[0] in _GIVEN else 0
    elif kind == "phone":
        known = 1 if any(digits[:n] in _CALLING_CODES for n in (1, 2)) else 0
    elif kind != "account" and _UNIT.match(text, end):
        known = -1
    against = kind == "number" and _NOT_SHAPE.fullmatch(span)
    cue_against = _AGAINST.search(before)
    if kind == "person":
        against = _SENTENCE.search(before) and not before.endswith(_TITLES)
        cue_against = _NOT_NAME.search(before)
    votes = (
        valid,
        1 if numeric and _PHONE_SHAPE.fullmatch(span.lstrip("+0123456789 ") if kind == "phone" else span) else 0,
        1 if _ID_SHAPE.fullmatch(span) else 0,
        -1 if against else 0,
        known,
        1 if (_FOR_NAME if kind == "person" else _FOR).search(before) else 0,
        -1 if cue_against else 0,
    )
    code = 0
    for v in votes:
        code = code * 3 + v + 1
    size = min(3, len(digits) // 6)
    plain = int(not digits or len(digits) == end - start)
    return code * _N_FEATURES + (KINDS.index(kind) * 4 + size) * 2 + plain


def find_candidates(text: str) -> list[tuple[str, int, int, bool, int]]:
    """(kind, start, end, is it base, code) of every candidate of one text."""
    base, failed = base_spans(text)
    out = [(k, a, b, True, _code(text, k, a, b, 1)) for k, a, b in base]
    bad = set(failed)
    firsts: list[int] = []  # base spans, merged where they overlap
    lasts: list[int] = []
    for a, b in sorted((a, b) for _, a, b in base):
        if lasts and a < lasts[-1]:
            lasts[-1] = max(lasts[-1], b)
        else:
            firsts.append(a)
            lasts.append(b)

    def is_free(a: int, b: int) -> bool:
        i = bisect_left(firsts, b) - 1  # the last that starts before b
        return i < 0 or lasts[i] <= a

    if _DIGIT.search(text):
        for m in _GROUPS.finditer(text):
            a, b = m.span()
            if 7 <= len(_only_digits(m[0])) <= 15 and is_free(a, b):
                out.append(("number", a, b, False, _code(text, "number", a, b, -1 if (a, b) in bad else 0)))
    if _DIGIT.search(text):
        for m in _ACCOUNT.finditer(text):
            if is_free(*m.span()):
                valid = 1 if mod97(m[0].replace(" ", "")) else -1
                out.append(("account", *m.span(), False, _code(text, "account", *m.span(), valid)))
    names = set()
    for m in _NAMES.finditer(text):
        if is_free(*m.span()):
            names.add(m.span())
            out.append(("person", *m.span(), False, _code(text, "person", *m.span(), 0)))
    for cue in _TITLES + _INTRODUCTIONS:
        at = text.find(cue)
        while at >= 0:
            m = _NAME.match(text, at + len(cue))
            if m and " " not in m[0] and m.span() not in names and is_free(*m.span()):
                names.add(m.span())
                out.append(("person", *m.span(), False, _code(text, "person", *m.span(), 0)))
            at = text.find(cue, at + len(cue))
    if len(out) > 1:
        out.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return out


def _find_batch(texts: pa.Array) -> pa.Array:
    names = ("kind", "start", "end", "base", "code")
    out = pa.array([[dict(zip(names, s)) for s in find_candidates(t.as_py() or "")] for t in texts], type=_ARROW)
    give_back()
    return out


def candidates(text: Column) -> Column:
    """Column of all candidates of a text column, base spans among them."""
    return F.arrow_udf(_find_batch, FOUND_TYPE)(text)


def _unpack(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Votes (-1, 0, 1) and the one-hot features of codes."""
    packed, feature = codes // _N_FEATURES, codes % _N_FEATURES
    votes = np.stack([packed // 3 ** (N_VOTES - 1 - j) % 3 - 1 for j in range(N_VOTES)], axis=1)
    plain, size, kind = feature % 2, feature // 2 % 4, feature // 8
    onehot = [votes == 1, votes == -1, np.eye(len(KINDS))[kind], np.eye(4)[size], plain[:, None]]
    return votes, np.concatenate([np.asarray(x, dtype=float) for x in onehot], axis=1)


def estimate(votes: np.ndarray, kind: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each vote pattern, and reliability of each labeler, by EM.

    A labeler that votes is right with its own reliability; one that abstains
    says nothing.  Each kind has its own share of true spans.  Both have weak
    priors, so that kinds and labelers seen a few times stay near them.
    """
    reliability = np.full(votes.shape[1], 0.8)
    share = np.full(len(KINDS), 0.3)
    p = np.zeros(len(counts))
    for _ in range(rounds):
        odds = np.log(share / (1 - share))[kind] + votes @ np.log(reliability / (1 - reliability))
        p = 1 / (1 + np.exp(-odds))
        right = counts @ (np.where(votes == 1, p[:, None], 0) + np.where(votes == -1, 1 - p[:, None], 0))
        cast = counts @ (votes != 0)
        reliability = np.clip((right + 16) / (cast + 20), 0.55, 0.99)
        for k in range(len(KINDS)):
            at = kind == k
            share[k] = (counts[at] @ p[at] + 3) / (counts[at].sum() + 10)
    return p, reliability


def train(codes: np.ndarray, counts: np.ndarray) -> list[int]:
    """The codes that the final span classifier calls personal data."""
    if not len(codes):
        return []
    votes, x = _unpack(codes)
    p, _ = estimate(votes, codes % _N_FEATURES // 8, counts)
    weight = np.log1p(counts)  # so that one very common code does not drown the rest
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    for _ in range(30):  # Newton steps of a ridge logistic regression
        q = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        g = x1.T @ (weight * (q - p)) + 0.1 * w
        h = (x1 * (weight * q * (1 - q))[:, None]).T @ x1 + 0.1 * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    q = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
    return [int(c) for c, good in zip(codes, (q >= 0.5) & (votes == 1).any(axis=1)) if good]


def learn(found: DataFrame) -> list[int]:
    """Accepted codes, learned from the counts of all candidates in ``found``."""
    counted = found.select(F.explode("found").alias("c")).groupBy(F.col("c.code").alias("code")).count()
    rows = counted.collect()  # at most N_CODES rows
    rows.sort(key=lambda r: r[0])
    return train(np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=float))


def accepted_spans(found: Column, codes: list[int]) -> Column:
    """The candidates that are reported."""
    return F.filter(found, lambda c: c["base"] | c["code"].isin(codes) if codes else c["base"])


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``spans``: array<struct<kind, start, end, base, code>> for each row."""
    ship_package(df.sparkSession)
    found = df.select(df[id_col].alias("id"), candidates(text_of(df, text_col)).alias("found"))
    found = materialise(found, "pii")
    return found.select(F.col("id").alias(id_col), accepted_spans(F.col("found"), learn(found)).alias("spans"))


def _redact(text: str, accepted: frozenset[int]) -> str:
    at, parts = 0, []
    for kind, a, b, base, code in find_candidates(text):
        if (base or code in accepted) and b > at:
            if a >= at:
                parts += [text[at:a], f"[{kind.upper()}]"]
            at = b
    return "".join([*parts, text[at:]])


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``df``, each reported span replaced by its kind.

    Overlapping spans become the mark of the first.  Null texts stay null.
    """
    ship_package(df.sparkSession)
    found = df.select(candidates(text_of(df, text_col)).alias("found")).where(F.size("found") > 0)
    accepted = frozenset(learn(materialise(found, "pii")))

    def cut(texts: pa.Array) -> pa.Array:
        values = (t.as_py() for t in texts)
        out = pa.array([None if t is None else _redact(t, accepted) for t in values], type=pa.string())
        give_back()
        return out

    name = fresh_name(df, "redacted")
    out = df.withColumn(name, F.arrow_udf(cut, "string")(df[text_col].cast("string")))
    return out.select(*[F.col(name).alias(c) if c == text_col else out[c] for c in df.columns])


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digest of base spans, all spans."""
    got = personal_data(table(spark, sf_dir, "documents"))
    base = F.filter(F.col("spans"), lambda s: s["base"])
    return got.select(
        "doc_id",
        *[count_kind(base, k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(span_list(base), 256).alias("base_sha256"),
        span_list(F.col("spans")).alias("spans"),
    )


QUERIES = {"op6_pii": op6_pii}
ORACLE_SQL: dict[str, str] = {}
