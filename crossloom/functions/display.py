"""How values are shown: number formats, blanks, conditional colours, filter summaries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from crossloom.plans.errors import PivotError
from crossloom.plans.request import Filter, ShowAs


@dataclass(frozen=True)
class Format:
    """number, currency or percent; 0 to 6 decimals; grouped thousands; a currency sign."""

    kind: str = "number"
    decimals: int = 2
    grouping: bool = True
    currency: str = "₺"

    def __post_init__(self) -> None:
        if self.kind not in ("number", "currency", "percent") or not 0 <= self.decimals <= 6 or (self.kind == "currency" and not self.currency.strip()):
            raise PivotError(f"not a format: {self}")

    def column(self, value: Column, show_as: ShowAs = ShowAs.NORMAL) -> Column:
        """Shown text. A percent format takes ratios as they are and divides other values by 100 first."""
        number = value.cast("double")
        if self.kind == "percent":
            number = number * (100 if show_as.is_ratio else 1)
        text = F.format_number(number, self.decimals) if self.grouping else F.format_string(f"%.{self.decimals}f", number)
        text = F.concat(text, F.lit("%")) if self.kind == "percent" else F.concat(F.lit(self.currency), text) if self.kind == "currency" else text
        return F.when(value.isNotNull(), text)

    def excel(self) -> str:
        """The number format that a workbook has for it."""
        body = ("#,##0" if self.grouping else "0") + ("." + "0" * self.decimals if self.decimals else "")
        if self.kind == "percent":
            return ("0." + "0" * self.decimals if self.decimals else "0") + "%"
        return self.currency + body if self.kind == "currency" else body


def shown_label(column: Column, blank: str = "-") -> Column:
    return F.when(column == "", F.lit(blank)).otherwise(column)


def filter_summary(filters: Sequence[Filter], most: int = 6) -> str:
    """Fields and their first accepted values, with how many more there are."""
    parts = []
    for f in filters:
        if f.values:
            more = f" +{len(f.values) - most}" if len(f.values) > most else ""
            parts.append(f"{f.field}: " + ", ".join("-" if not v else v for v in f.values[:most]) + more)
    return "; ".join(parts)


@dataclass(frozen=True)
class Rule:
    """A colour for values: one of > >= < <= = and between, whose bounds may come in either order."""

    op: str
    threshold: float
    color: str
    second: float | None = None

    def __post_init__(self) -> None:
        if self.op not in (">", ">=", "<", "<=", "=", "between") or (self.op == "between" and self.second is None):
            raise PivotError(f"not a rule: {self}")

    def matches(self, value: Column) -> Column:
        v, a = value.cast("double"), F.lit(float(self.threshold))
        if self.op == "between":
            low, high = sorted((float(self.threshold), float(self.second)))
            return v.between(low, high)
        return {">": v > a, ">=": v >= a, "<": v < a, "<=": v <= a, "=": v == a}[self.op]


def highlight(value: Column, rules: Sequence[Rule]) -> Column:
    """The colour of the last rule that matches; null for null and where none does."""
    out = F.lit(None).cast("string")
    for r in rules:
        out = F.when(r.matches(value), F.lit(r.color)).otherwise(out)
    return F.when(value.isNotNull(), out)
