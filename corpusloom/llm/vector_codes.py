"""Compression of vectors to codes: one codebook for each part, entries found by vantage-point trees.

Components become integers, floor(``SCALE`` * x), and a vector is cut into
``PARTS`` consecutive parts.  Each part position has a codebook of at most
``ENTRIES`` integer entries, at first the parts of the least ids.  A round
assigns every part to its nearest entry and moves each entry to the floored mean
of its parts; an entry without parts stays.

Nearest entries are found by a vantage-point tree over the entries of a part
position.  A node knows the least and greatest distance from its vantage point
to the entries below it, rounded outwards; a batch of parts first descends to
its likeliest leaf, then visits every node whose lower bound does not exceed the
distance found so far (equal bounds are visited too, so ties are seen).  Entries
are compared by their squared distance as exact integers, ties by index.

Plan.  A round is one narrow pass that adds up, in each task, one row for each
entry (at most ``PARTS * ENTRIES`` rows a task), and one partially aggregated
sum.  What reaches the driver and goes to the tasks is the codebook: at most
``ENTRIES`` times the components of one vector.  Labels' errors are summed
before they are joined back, so a hot label is only one row of that table.

Defined cases: vectors that are null or hold null or non-finite components take
no part; vectors of each length have codebooks of their own; where the length is
no multiple of ``PARTS`` the first parts are longer by one, and an empty part is
at distance 0 from entry 0; ids that are null come last and equal ids are
ordered by vector; repeated rows are rows like any other; with fewer than
``ENTRIES`` rows there are fewer entries; integers are held within +-10**27 and
errors within the greatest long; an empty table gives no rows; further columns
play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table
from corpusloom.sources.session import materialise, ship_package

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
LEAF = 8
#: Parts that search a tree together.
BATCH = 8192
GREATEST = (1 << 63) - 1
#: Integers beyond are held at this bound.
HELD = 10**27
#: Relative slack of distances; far more than the error of a square root and a difference.
_SLACK = 2.0**-40


class VantageTree:
    """A vantage-point tree over integer points."""

    def __init__(self, points: np.ndarray) -> None:
        self.points = points
        self.own = (points * points).sum(axis=1)
        self.root = self._build(np.arange(len(points)))

    @staticmethod
    def _square(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        d = x - y
        return (d * d).sum(axis=-1)

    def _build(self, members: np.ndarray) -> tuple:
        """A leaf is (members,); a node is (vantage point, its two children with the bounds of their distances)."""
        if len(members) <= LEAF:
            return (members,)
        middle = self.points[members].astype(np.float64).mean(axis=0)
        vantage = members[((self.points[members].astype(np.float64) - middle) ** 2).sum(axis=1).argmax()]
        rest = members[members != vantage]
        far = np.sqrt(self._square(self.points[rest], self.points[vantage]).astype(np.float64))
        order = np.argsort(far, kind="stable")
        rest, far = rest[order], far[order]
        half = len(rest) // 2
        children = [
            (self._build(np.sort(rest[part])), far[part][0] * (1 - _SLACK), far[part][-1] * (1 + _SLACK))
            for part in (slice(0, half), slice(half, None))
        ]
        return (vantage, children)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and exact squared distance of the nearest point of each row; ties go to the lower index."""
        n = len(x)
        own = (x * x).sum(axis=1)

        def squares(rows: np.ndarray, members: np.ndarray) -> np.ndarray:
            return own[rows, None] - 2 * (x[rows] @ self.points[members].T) + self.own[members]

        everything = np.arange(n)
        index = np.zeros(n, dtype=np.int64)
        best = squares(everything, np.zeros(1, dtype=np.int64))[:, 0]

        def try_points(members: np.ndarray, rows: np.ndarray) -> np.ndarray:
            """Compare rows with points in ascending order; their squared distances."""
            d = squares(rows, members)
            at = d.argmin(axis=1)  # the first of equals
            least, e = d[np.arange(len(rows)), at], members[at]
            old = best[rows]
            better = ((least < old) | ((least == old) & (e < index[rows]))).astype(bool)
            best[rows[better]], index[rows[better]] = least[better], e[better]
            return d

        def bounds(children: list, far: np.ndarray) -> list[np.ndarray]:
            """Lower bounds of the distances to what lies below each child."""
            low, high = far * (1 - _SLACK), far * (1 + _SLACK)
            return [np.maximum(low - most, least - high) for _, least, most in children]

        def descend(node: tuple, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if len(node) == 1:
                try_points(node[0], rows)
                return
            vantage, children = node
            far = np.sqrt(try_points(np.array([vantage]), rows)[:, 0].astype(np.float64))
            first, second = bounds(children, far)
            descend(children[0][0], rows[first <= second])
            descend(children[1][0], rows[first > second])

        def visit(node: tuple, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if len(node) == 1:
                try_points(node[0], rows)
                return
            vantage, children = node
            far = np.sqrt(try_points(np.array([vantage]), rows)[:, 0].astype(np.float64))
            for (child, _, _), bound in zip(children, bounds(children, far)):
                reach = np.sqrt(best[rows].astype(np.float64)) * (1 + _SLACK)
                visit(child, rows[bound <= reach])

        descend(self.root, everything)
        visit(self.root, everything)
        return index, best


def cuts(length: int, parts: int) -> list[int]:
    """Where the parts of a vector begin, and its end."""
    size, more = divmod(length, parts)
    return [p * size + min(p, more) for p in range(parts + 1)]


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x): as float64 where all arithmetic on them is exact in it, else as Python integers."""
    scaled = np.floor(x.astype(np.float64) * SCALE)
    most = np.abs(scaled).max(initial=0.0)
    if max(1, x.shape[-1]) * (2 * most) ** 2 < 2.0**52:
        return scaled + 0.0
    held = [[max(-HELD, min(HELD, int(v))) for v in row] for row in scaled.tolist()]
    return np.array(held, dtype=object).reshape(scaled.shape)


def _books(codebooks: list[list[list[int]]]) -> list[np.ndarray]:
    """The entries of each part position, as float64 where they are small enough."""
    out = []
    for entries in codebooks:
        width = len(entries[0])
        most = max((abs(v) for e in entries for v in e), default=0)
        small = max(1, width) * (2 * most) ** 2 < 2**52
        out.append(np.array(entries, dtype=np.float64 if small else object).reshape(len(entries), width))
    return out


class _Coder:
    """Codes of batches of vectors by the codebooks of one length."""

    def __init__(self, codebooks: list[list[list[int]]], length: int) -> None:
        self.at = cuts(length, len(codebooks))
        self.books = _books(codebooks)
        self.trees = [VantageTree(b) for b in self.books]

    def __call__(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(part position, parts, codes, squared distances) for each part position."""
        for p, (a, b) in enumerate(zip(self.at, self.at[1:])):
            tree, part = self.trees[p], x[:, a:b]
            # Sums of squares are exact in float64 only where both sides are small together.
            if part.dtype != tree.points.dtype or not self._small(part, tree.points):
                part = self._exact(part)
                tree = VantageTree(self._exact(tree.points))
            got = [tree.nearest(part[i : i + BATCH]) for i in range(0, len(part), BATCH)]
            yield p, part, np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])

    @staticmethod
    def _small(x: np.ndarray, y: np.ndarray) -> bool:
        if x.dtype == object:
            return True
        most = np.abs(x).max(initial=0.0) + np.abs(y).max(initial=0.0)
        return max(1, x.shape[1]) * most**2 < 2.0**53

    @staticmethod
    def _exact(x: np.ndarray) -> np.ndarray:
        return np.array([[int(v) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)


def _vectors(column: pa.Array, length: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), length)


def _sums(batches: Iterator[pa.RecordBatch], codebooks: list, length: int) -> Iterator[pa.RecordBatch]:
    """For each entry that a task's parts are nearest to: how many they are, and their componentwise sum."""
    coder = _Coder(codebooks, length)
    total = [np.zeros(b.shape, dtype=object) for b in coder.books]
    count = [np.zeros(len(b), dtype=np.int64) for b in coder.books]
    for batch in batches:
        if not batch.num_rows:
            continue
        x = integers(_vectors(batch.column(0), length))
        for p, part, codes, _ in coder(x):
            own = np.zeros(total[p].shape, dtype=object if part.dtype == object else np.int64)
            np.add.at(own, codes, part if part.dtype == object else part.astype(np.int64))
            total[p] += own
            count[p] += np.bincount(codes, minlength=len(count[p]))
    rows = [(p, e) for p in range(len(total)) for e in np.flatnonzero(count[p]).tolist()]
    kind = pa.list_(pa.decimal128(38, 0))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([p for p, _ in rows], type=pa.int32()),
            pa.array([e for _, e in rows], type=pa.int32()),
            pa.array([int(count[p][e]) for p, e in rows], type=pa.int64()),
            pa.array([[Decimal(int(v)) for v in total[p][e]] for p, e in rows], type=kind),
        ],
        names=["part", "entry", "n", "sums"],
    )


def _encode(batches: Iterator[pa.RecordBatch], codebooks: list, length: int, digest: str) -> Iterator[pa.RecordBatch]:
    coder = _Coder(codebooks, length)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        error, codes = np.zeros(n, dtype=object), []
        for _, _, code, far in coder(integers(_vectors(batch.column(2), length))):
            codes.append(code)
            error += np.array([int(d) for d in far.tolist()], dtype=object)
        told = ["".join(f"{c:02x}" for c in row) for row in zip(*[c.tolist() for c in codes])]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), pa.array(told, type=pa.string()),
                pa.array([min(e, GREATEST) for e in error.tolist()], type=pa.int64()), pa.array([digest] * n, type=pa.string()),
            ],
            names=["id", "label", "code", "error", "codebooks_sha256"],
        )


def _kept(x: Column) -> Column:
    """Whether a vector takes part."""
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.coalesce(~bad, F.lit(False))


def train(rows: DataFrame, length: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[list[list[int]]]:
    """The codebooks of a table (id, x) of vectors of one length: entries by part position."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    seed = integers(np.array([r["x"] for r in first], dtype=np.float64).reshape(len(first), length))
    at = cuts(length, parts)
    books = [[[int(v) for v in row[a:b]] for row in seed.tolist()] for a, b in zip(at, at[1:])]
    for _ in range(rounds):
        step = rows.select("x").mapInArrow(
            lambda it, now=books: _sums(it, now, length), "part int, entry int, n long, sums array<decimal(38,0)>"
        )
        # One row for each entry and place in it; counts at place -1.
        told = F.concat(F.array(F.col("n").cast("decimal(38,0)")), "sums")
        added = step.select("part", "entry", F.posexplode(told).alias("place", "value"))
        added = added.groupBy("part", "entry", "place").agg(F.sum("value").alias("value"))
        moved: dict[tuple[int, int], dict[int, int]] = {}
        for r in added.collect():  # as many numbers as the codebook has
            moved.setdefault((r["part"], r["entry"]), {})[r["place"]] = int(r["value"])
        books = [
            [[moved[p, e][i + 1] // moved[p, e][0] for i in range(len(old))] if (p, e) in moved else old for e, old in enumerate(book)]
            for p, book in enumerate(books)
        ]
    return books


def codebook_digest(books: list[list[list[int]]]) -> str:
    """SHA-256 of all components, as decimal integers joined by commas."""
    return hashlib.sha256(",".join(str(v) for book in books for e in book for v in e).encode()).hexdigest()


def compress(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS,
    entries: int = ENTRIES, rounds: int = ROUNDS,
) -> DataFrame:
    """(id, label, code, error, label_error, codebooks_sha256) of every vector that takes part."""
    ship_package(df.sparkSession)
    rows = df.select(df[id_col].alias("id"), df[label_col].alias("label"), df[vector_col].cast("array<double>").alias("x"))
    rows = rows.where(_kept(F.col("x")))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = f"id {kinds['id']}, label {kinds['label']}, code string, error long, codebooks_sha256 string"
    encoded = df.sparkSession.createDataFrame([], out)
    # One length in all but odd tables; each length is a table of its own.
    for length in sorted(r["n"] for r in rows.select(F.size("x").alias("n")).distinct().collect()):
        own = rows.where(F.size("x") == length)
        books = train(own, length, parts, entries, rounds)
        digest = codebook_digest(books)
        coded = own.select("id", "label", "x").mapInArrow(lambda it, b=books, n=length, d=digest: _encode(it, b, n, d), out)
        encoded = encoded.union(materialise(coded, "codes"))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(Decimal(GREATEST))).cast("long")
    by_label = materialise(encoded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error")), "errors")
    return encoded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).drop("of")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every vector, by codebooks of 256 entries for each of 4 parts after 4 rounds."""
    coded = compress(table(spark, sf_dir, "embeddings"))
    return coded.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


def _sql() -> str:
    """The same in SQL: every part against every entry, round after round."""
    ctes = [
        f"k as (select vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v, "
        "row_number() over (order by vec_id, embedding) as rn from embeddings where embedding is not null and "
        "len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        f"p as (select rn, part, v[part * (len(v) // {PARTS}) + 1:(part + 1) * (len(v) // {PARTS})] as x from k, "
        f"(select unnest(range({PARTS})) as part))",
        f"c0 as (select part, rn - 1 as e, x as y from p where rn <= {ENTRIES})",
    ]
    for i in range(ROUNDS + 1):
        ctes.append(
            f"d{i} as (select rn, part, x, e, list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint "
            f"as d from p join c{i} using (part))"
        )
        ctes.append(f"a{i} as (select rn, part, min(d) as d, arg_min(e, (d::hugeint * 1000 + e)) as e, any_value(x) as x from d{i} group by rn, part)")
        if i < ROUNDS:
            ctes.append(
                f"s{i} as (select part, e, pos, sum(v)::bigint as s, count(*) as n from (select part, e, unnest(x) as v, "
                f"unnest(range(len(x))) as pos from a{i}) group by part, e, pos)"
            )
            ctes.append(f"m{i} as (select part, e, list((s - ((s % n + n) % n)) // n order by pos) as y from s{i} group by part, e)")
            ctes.append(f"c{i + 1} as (select part, e, coalesce(m{i}.y, c{i}.y) as y from c{i} left join m{i} using (part, e))")
    last = ROUNDS
    ctes.append(
        f"h as (select sha256(string_agg(v::varchar, ',' order by part, e, pos)) as codebooks_sha256 from (select part, e, "
        f"unnest(y) as v, unnest(range(len(y))) as pos from c{last}))"
    )
    ctes.append(f"r as (select rn, string_agg(printf('%02x', e), '' order by part) as code, sum(d)::bigint as error from a{last} group by rn)")
    return (
        "with " + ", ".join(ctes) + " select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, "
        "codebooks_sha256 from r join k using (rn), h"
    )


QUERIES = {"op11_vector_codes": op11_vector_codes}
ORACLE_SQL: dict[str, str] = {"op11_vector_codes": _sql()}
