"""Validation and normalisation of identifiers ``YY0XXX-SS`` as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillfold.config import FAILED_MARKERS, ValidationConfig

# Noise to blank out, in this order, case-insensitively: fixed values.
EXCLUSIONS = (
    r"\b(?:JOB|NO|NUMBER|RING|OUT|RINGOUT|ENGR|REV|REVISION|PAGE|SCALE|SIZE|DATE|TITLE|APPROVED|CHECKED|BY|ENGINEER|ISSUED|CONSTRUCTION|PRELIMINARY|FINAL|AS-BUILT)\b",
    r"\b[A-Z]{2,4}\s*[-–—]\s*\d{1,4}\b",
    r"^\s*\d{1,3}\s*$",
    r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}",
    r"\b(?:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)\s*\d{1,2}",
    r"\(?\d{3}\)?[-\s.]?\d{3}[-\s.]?\d{4}",
    r"\bD[-–—]\d+\b",
    r"\bE[-–—]\d+\b",
    r"\bS\d{3}[-–—]\d+\b",
    r"\b20\d{6}\b",
    r"\bAPPROVED[\s:]*\d+\b",
)
# Characters that readers confuse, and what they stand for: fixed values.
CONFUSED = "OoUuQIl|LSsBGZzgq~/_=≡"
MEANT = "00000111155862299-----"
SEPARATORS = r"[-. =–—]+"

_VERDICT = "struct<is_valid:boolean,normalized:string,reason:string>"


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def strip_exclusions(text: Column) -> Column:
    for pattern in EXCLUSIONS:
        text = F.regexp_replace(text, "(?i)" + pattern, " ")
    return text


def clean(text: Column) -> Column:
    """Exclusions blanked, confusions resolved, other characters dropped."""
    t = F.translate(strip_exclusions(text), CONFUSED, MEANT)
    t = F.regexp_replace(F.regexp_replace(t, r"[^0-9A-Za-z\-. =\n]", ""), r"^\s+|\s+$", "")
    return F.regexp_replace(t, r"(\d)E(\d)", "$1-$2")


class Validator:
    """Builds verdicts for one window of years."""

    def __init__(self, config: ValidationConfig = ValidationConfig()):
        self.config = config
        year = "(?:" + "|".join(f"{y:02d}" for y in config.years) + ")"
        base = year + r"\s*0\s*\d\s*\d\s*\d"
        gap = rf"\s*(?:{SEPARATORS})?\s*"
        tail = r"(\d{2})(?![0-9A-Za-z])"
        self.strict = rf"(?<!\d)({base})({gap}){tail}"
        self.loose = rf"(?<!\d)({base})({gap})(\d{{2}})?"
        self.plain = rf"^{year}0\d{{3}}(-\d{{2}})?$"
        self.headless = rf"(?:^|\D)(\d)(\s*0\s*\d\s*\d\s*\d){gap}{tail}"

    def verdict(self, text: Column) -> Column:
        """struct<is_valid, normalized, reason>; confidence never changes it."""
        whole = F.coalesce(F.rlike(text, F.lit(self.plain)), F.lit(False))  # no noise, nothing to mend
        return F.when(whole, self._yes(text)).when(F.coalesce(text, F.lit("")) == "", self._no("empty_input")).otherwise(_let(clean(text), self._of_clean))

    def normalize(self, text: Column) -> Column:
        return self.verdict(text)["normalized"]

    def is_valid(self, text: Column) -> Column:
        return F.coalesce(self.verdict(text)["is_valid"], F.lit(False))

    def base(self, text: Column) -> Column:
        """The identifier before its suffix; null if invalid."""
        return F.split_part(self.normalize(text), F.lit("-"), F.lit(1))

    def is_year_valid(self, year: Column) -> Column:
        y = year.try_cast("int")
        return F.coalesce(y.between(self.config.years.start, self.config.years.stop - 1), F.lit(False))

    @staticmethod
    def is_structural(text: Column) -> Column:
        return F.coalesce(F.rlike(text, F.lit(r"^\d{6}(-\d{2})?$")), F.lit(False))

    def _no(self, reason: str) -> Column:
        return F.struct(F.lit(False).alias("is_valid"), F.lit(None).cast("string").alias("normalized"), F.lit(reason).alias("reason"))

    def _yes(self, value: Column) -> Column:
        return F.struct(F.lit(True).alias("is_valid"), value.alias("normalized"), F.lit(None).cast("string").alias("reason"))

    def _of_clean(self, t: Column) -> Column:
        legacy = F.regexp_extract(t, r"\b(11[01]\d{4})\b", 1)
        strict, loose = self._match(t, self.strict), self._match(t, self.loose)
        rescued = self._rescue(t)
        return (
            F.when(t == "", self._no("no_content_after_normalization"))
            .when(legacy != "", self._yes(legacy))
            .otherwise(_let(F.coalesce(strict, loose, rescued), lambda v: F.when(v.isNull(), self._no("no_pattern_match")).otherwise(self._yes(v))))
        )

    @staticmethod
    def _groups(t: Column, pattern: str, of_groups: Callable[[Callable[[int], Column]], Column]) -> Column:
        """of_groups(group by number) of the first match, from one run of the pattern; null without one."""
        marked = F.regexp_replace(t, rf"(?s)^.*?{pattern}.*$", "$1\u0001$2\u0001$3")
        return _let(F.split(marked, "\u0001"), lambda g: F.when(F.size(g) == 3, of_groups(lambda i: F.get(g, F.lit(i - 1)))))

    def _match(self, t: Column, pattern: str) -> Column:
        """The identifier that pattern finds, null if none or broken over more than one line."""

        def found(group: Callable[[int], Column]) -> Column:
            gap, suffix = group(2), group(3)
            broken = (suffix != "") & (F.length(gap) - F.length(F.replace(gap, F.lit("\n"), F.lit(""))) > 1)
            return F.when(~broken, F.concat(F.regexp_replace(group(1), r"\s+", ""), F.when(suffix != "", F.concat(F.lit("-"), suffix)).otherwise(F.lit(""))))

        return self._groups(t, pattern, found)

    def _rescue(self, t: Column) -> Column:
        """The first decade that makes a lone year digit valid."""

        def found(group: Callable[[int], Column]) -> Column:
            year = F.lit(None).cast("string")
            for y in sorted(self.config.years, reverse=True):
                if y < 100:
                    year = F.when(group(1) == str(y % 10), F.lit(f"{y:02d}")).otherwise(year)
            return F.concat(year, F.regexp_replace(group(2), r"\s+", ""), F.lit("-"), group(3))

        return self._groups(t, self.headless, found)


def is_failed(job: Column) -> Column:
    return job.isNull() | job.isin(*FAILED_MARKERS)
