"""The built-in checks, in registration order."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import language, many_patterns, minhash, patterns, repair, tokens
from corpusloom.functions import text as T
from corpusloom.outcome import ERROR, INFO, WARNING, Outcome, Record
from corpusloom.operators.base import BaseChecker, Finding, is_text
from corpusloom.operators.registry import register
from corpusloom.sources.session import materialise, ship_package

#: Tags from which on a text counts as HTML.
HTML_TAGS = 5
#: Boilerplate patterns that are tried one by one.
JVM_PATTERNS = 16


def _true(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


@register
class MissingFieldChecker(BaseChecker):
    """Null texts and texts of white space alone."""

    name = "missing_field"

    def measures(self, text: Column) -> dict[str, Column]:
        return {"missing": F.coalesce(T.is_blank(text), ~F.col("present"))}

    def findings(self, text_field: str) -> list[Finding]:
        return [Finding("missing", ERROR, f"Found {{n}} rows with missing/empty '{text_field}'")]

    def stats(self, total_rows: int, flagged: dict[str, int], sums: dict[str, Any]) -> dict[str, Any]:
        n = flagged["missing"]
        return {"total_rows": total_rows, "missing_count": n, "missing_ratio": n / max(total_rows, 1)}


@register
class SchemaChecker(BaseChecker):
    """Whether the text column is there and holds strings; looks at no row."""

    name = "schema"

    def look(self, df: DataFrame, text_field: str, total_rows: int) -> Outcome:
        kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        records = []
        if text_field not in kinds:
            message = f"Text field '{text_field}' not in schema"
            records.append(Record(self.name, ERROR, message, details={"available_fields": list(kinds)}))
        elif not is_text(df, text_field):
            message = f"Text field '{text_field}' has unexpected type: {kinds[text_field]}"
            records.append(Record(self.name, WARNING, message))
        return Outcome({self.name: {"columns": list(kinds), "features": kinds, "num_rows": total_rows}}, records)


@register
class TextLengthChecker(BaseChecker):
    """Texts shorter or longer than the bounds, in code points."""

    name = "text_length"

    def measures(self, text: Column) -> dict[str, Column]:
        n = F.length(text)
        return {"short": _true(n < self.config.min_length), "long": _true(n > self.config.max_length)}

    def findings(self, text_field: str) -> list[Finding]:
        low, high = self.config.min_length, self.config.max_length
        return [
            Finding("short", WARNING, f"Found {{n}} rows with text shorter than {low} characters"),
            Finding("long", WARNING, f"Found {{n}} rows with text longer than {high} characters"),
        ]

    def stats(self, total_rows: int, flagged: dict[str, int], sums: dict[str, Any]) -> dict[str, Any]:
        return {
            "total_rows": total_rows,
            "too_short_count": flagged["short"],
            "too_long_count": flagged["long"],
            "min_length_threshold": self.config.min_length,
            "max_length_threshold": self.config.max_length,
        }


@register
class LanguageChecker(BaseChecker):
    """Texts that are, with enough confidence, in a language not asked for.

    Languages are told by the settings' model where there is one, else by scripts
    and function words.
    """

    name = "language"

    def predict(self, text: Column) -> Column:
        """Column struct<lang, score, ...> of a text."""
        model = self.config.language_model
        return language.predict(text) if model is None else model.predict(text)

    def measures(self, text: Column) -> dict[str, Column]:
        guess = self.predict(text)
        return {"known": guess["lang"].isNotNull(), "other": self.is_other(guess["lang"], guess["score"])}

    def is_other(self, lang: Column, score: Column) -> Column:
        return _true(~lang.isin(self.config.languages) & (score >= self.config.language_threshold))

    def totals(self) -> list[str]:
        return ["known"]

    def findings(self, text_field: str) -> list[Finding]:
        allowed = self.config.languages
        return [Finding("other", WARNING, f"Found {{n}} rows with non-target language (allowed: {allowed})")]

    def stats(self, total_rows: int, flagged: dict[str, int], sums: dict[str, Any]) -> dict[str, Any]:
        return {"checked_count": sums["known"], "non_target_count": flagged["other"]}


@register
class HtmlChecker(BaseChecker):
    """Texts with several HTML tags."""

    name = "html"

    def measures(self, text: Column) -> dict[str, Column]:
        return {"tagged": _true(T.count_html_tags(text) >= HTML_TAGS)}

    def findings(self, text_field: str) -> list[Finding]:
        return [Finding("tagged", WARNING, f"Found {{n}} rows with {HTML_TAGS} or more HTML tags")]

    def stats(self, total_rows: int, flagged: dict[str, int], sums: dict[str, Any]) -> dict[str, Any]:
        return {"total_rows": total_rows, "html_detected_count": flagged["tagged"]}


@register
class MojibakeChecker(BaseChecker):
    """Texts that text repair would change."""

    name = "mojibake"

    def measures(self, text: Column) -> dict[str, Column]:
        return {"garbled": repair.has_mojibake(text)}

    def findings(self, text_field: str) -> list[Finding]:
        return [Finding("garbled", WARNING, "Found {n} rows with suspected mojibake (garbled characters)")]

    def stats(self, total_rows: int, flagged: dict[str, int], sums: dict[str, Any]) -> dict[str, Any]:
        return {"total_rows": total_rows, "mojibake_count": flagged["garbled"]}


class _DuplicateChecker(BaseChecker):
    def skipped(self) -> bool:
        return self.config.skip_duplicates


@register
class ExactDuplicateChecker(_DuplicateChecker):
    """Rows whose text occurs more than once; all of them."""

    name = "exact_duplicate"

    def measures(self, text: Column) -> dict[str, Column]:
        return {"text": text.isNotNull()}

    def shared(self, rows: DataFrame) -> DataFrame:
        """(row_id, hash) of the texts that occur more than once.

        Texts are shuffled as hashes alone.  Groups are found by a partial
        aggregate and joined back, which adaptive execution splits where one
        text fills a partition.
        """
        hashed = rows.where(F.col("text").isNotNull()).select("row_id", T.sha256_hash(F.col("text")).alias("hash"))
        groups = hashed.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
        return materialise(hashed.join(groups, "hash"), "twins")

    def of_shared(self, shared: DataFrame) -> tuple[list[str], DataFrame]:
        """Flags, and whether the row is another than the first of its group."""
        groups = shared.groupBy("hash").agg(F.count("*").alias("n"), F.min("row_id").alias("first")).where("n > 1")
        later = F.col("row_id") != F.col("first")
        members = shared.join(groups, "hash")
        return ["twin", "later"], members.select("row_id", F.lit(True).alias("twin"), later.alias("later"))

    def totals(self) -> list[str]:
        # Each group of n rows has n - 1 that are not its first.
        return ["later", "text"]

    def findings(self, text_field: str) -> list[Finding]:
        return [Finding("twin", WARNING, "Found {n} rows that are exact duplicates (by SHA-256 hash)")]

    def stats(self, total_rows: int, flagged: dict[str, int], sums: dict[str, Any]) -> dict[str, Any]:
        distinct = sums["text"] - sums["later"]
        return {"total_rows": total_rows, "duplicate_count": flagged["twin"], "unique_count": distinct}


@register
class NearDuplicateChecker(_DuplicateChecker):
    """Rows that share an LSH band with another row."""

    name = "near_duplicate"

    def bands(self, rows: DataFrame) -> DataFrame:
        """(row_id, band, key): the band keys of every row that has words.

        They are written, so that counting the keys and joining back compute
        signatures once.
        """
        return materialise(self._bands(rows), "bands")

    def _bands(self, rows: DataFrame) -> DataFrame:
        ship_package(rows.sparkSession)
        bands, per = minhash.band_shape(self.config.minhash_threshold, self.config.minhash_num_perm)
        signed = rows.select(
            "row_id", minhash.signature(F.col("text"), self.config.minhash_num_perm).alias("signature")
        ).where(F.size("signature") > 0)
        keys = minhash.band_keys(F.col("signature"), bands, per)
        return signed.select("row_id", F.posexplode(keys).alias("band", "key"))

    def shared(self, rows: DataFrame) -> DataFrame:
        """(row_id, band, key) of the bands that rows have in common."""
        bands = self.bands(rows)
        groups = bands.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").select("band", "key")
        groups = materialise(groups, "shared")  # as a table, so that the join can be split at a hot key
        return materialise(bands.join(groups, ["band", "key"]), "alike")

    def of_shared(self, shared: DataFrame) -> tuple[list[str], DataFrame]:
        flagged = self.links(shared).select("row_id").distinct()
        return ["alike"], flagged.withColumn("alike", F.lit(True))

    def links(self, shared: DataFrame) -> DataFrame:
        """(first, row_id) for each band that rows have in common: a star of links, not all pairs."""
        stars = shared.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("row_id").alias("first")).where("n > 1")
        return shared.join(stars, ["band", "key"]).select("first", "row_id").distinct()

    def candidates(self, rows: DataFrame) -> DataFrame:
        """The links of a table of rows."""
        return self.links(self.shared(rows))

    def findings(self, text_field: str) -> list[Finding]:
        t = self.config.minhash_threshold
        return [Finding("alike", WARNING, f"Found {{n}} rows that are near-duplicates (MinHash Jaccard threshold={t})")]

    def stats(self, total_rows: int, flagged: dict[str, int], sums: dict[str, Any]) -> dict[str, Any]:
        return {"total_rows": total_rows, "near_duplicate_count": flagged["alike"]}


@register
class PiiChecker(BaseChecker):
    """Personal data by pattern."""

    name = "pii"

    def skipped(self) -> bool:
        return not self.config.detect_pii

    def measures(self, text: Column) -> dict[str, Column]:
        counts = {f"n_{k}": c for k, c in T.pii_counts(text).items()}
        return {"found": _true(reduce(Column.__add__, counts.values()) > 0), **counts}  # each count is computed once

    def totals(self) -> list[str]:
        return [f"n_{k}" for k in patterns.PII]

    def findings(self, text_field: str) -> list[Finding]:
        return [Finding("found", WARNING, "Found {n} rows containing PII")]

    def details(self, finding: Finding, sums: dict[str, Any]) -> dict[str, Any]:
        return {"pii_types": {k: sums[f"n_{k}"] for k in patterns.PII if sums[f"n_{k}"]}}

    def stats(self, total_rows: int, flagged: dict[str, int], sums: dict[str, Any]) -> dict[str, Any]:
        seen = {f"pii_{k}_count": sums[f"n_{k}"] for k in patterns.PII if sums[f"n_{k}"]}
        return {"total_rows": total_rows, "pii_detected_count": flagged["found"], **seen}

    @staticmethod
    def matches(rows: DataFrame) -> DataFrame:
        """(row_id, pii_type, value, start, end): one row for each match; unbounded, so a table."""
        return rows.select("row_id", F.explode(T.detect_pii(F.col("text"))).alias("m")).select("row_id", "m.*")


@register
class TokenLengthChecker(BaseChecker):
    """Texts of more tokens than the bound."""

    name = "token_length"

    def count(self, text: Column) -> Column:
        tokens.encoding(self.config.token_encoding)  # fails here, not in a worker
        return tokens.count_tokens(text, self.config.token_encoding, self.config.max_token_length)

    def measures(self, text: Column) -> dict[str, Column]:
        return {"over": _true(self.count(text) > self.config.max_token_length)}

    def findings(self, text_field: str) -> list[Finding]:
        return [Finding("over", WARNING, f"Found {{n}} rows exceeding max token length ({self.config.max_token_length})")]

    def details(self, finding: Finding, sums: dict[str, Any]) -> dict[str, Any]:
        return {"max_token_length": self.config.max_token_length}

    def stats(self, total_rows: int, flagged: dict[str, int], sums: dict[str, Any]) -> dict[str, Any]:
        return {"total_rows": total_rows, "over_limit_count": flagged["over"]}

    def over_limit(self, rows: DataFrame) -> DataFrame:
        """(row_id, token_count) of the texts over the bound."""
        return rows.select("row_id", self.count(F.col("text")).alias("token_count")).where(
            F.col("token_count") > self.config.max_token_length
        )


@register
class BoilerplateChecker(BaseChecker):
    """Boilerplate phrases, and texts dense with URLs or e-mail addresses."""

    name = "boilerplate"

    def first_match(self, text: Column) -> Column:
        """The first pattern, in the configured order, that a text matches; null if none.

        A few are tried one by one inside the JVM; many are looked for in one scan.
        """
        if len(self.config.boilerplate_patterns) > JVM_PATTERNS:
            return many_patterns.first_match(text, self.config.boilerplate_patterns)
        tests = [F.when(text.rlike(patterns.to_java(p)), F.lit(p)) for p in self.config.boilerplate_patterns]
        return F.coalesce(*tests, F.lit(None).cast("string"))

    def measures(self, text: Column) -> dict[str, Column]:
        return {
            "phrase": self.first_match(text).isNotNull(),
            "urls": _true(T.url_density(text) > self.config.max_url_density),
            "emails": _true(T.email_density(text) > self.config.max_email_density),
        }

    def findings(self, text_field: str) -> list[Finding]:
        url, email = self.config.max_url_density, self.config.max_email_density
        return [
            Finding("phrase", INFO, "Found {n} rows with boilerplate text"),
            Finding("urls", WARNING, f"Found {{n}} rows with URL density exceeding {url}"),
            Finding("emails", WARNING, f"Found {{n}} rows with email density exceeding {email}"),
        ]

    def details(self, finding: Finding, sums: dict[str, Any]) -> dict[str, Any]:
        return {
            "urls": {"max_url_density": self.config.max_url_density},
            "emails": {"max_email_density": self.config.max_email_density},
        }.get(finding.flag, {})

    def stats(self, total_rows: int, flagged: dict[str, int], sums: dict[str, Any]) -> dict[str, Any]:
        return {
            "total_rows": total_rows,
            "boilerplate_count": flagged["phrase"],
            "high_url_density_count": flagged["urls"],
            "high_email_density_count": flagged["emails"],
        }

    def matches(self, rows: DataFrame) -> DataFrame:
        """(row_id, matched_pattern) of the texts with a phrase."""
        return rows.select("row_id", self.first_match(F.col("text")).alias("matched_pattern")).where(
            "matched_pattern is not null"
        )
