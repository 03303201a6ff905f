"""Parameters of a view: period, lens, compared selections."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class QueryParams:
    """A closed period ``first``..``last`` within ``span``, a lens, up to three selections in slots."""

    first: int
    last: int
    span: tuple[int, int]
    lens: int | None = None
    slots: tuple[str, ...] = ()
    known: frozenset[str] = field(default_factory=frozenset)

    @property
    def is_all(self) -> bool:
        return (self.first, self.last) == self.span

    @property
    def single(self) -> int | None:
        return self.first if self.first == self.last else None

    @property
    def period_key(self) -> str | None:
        """The key of precomputed tables: all, one period, or none for a partial range."""
        return "all" if self.is_all else None if self.single is None else str(self.single)

    @property
    def label(self) -> str:
        return str(self.first) if self.single is not None else f"{self.first}–{self.last}"

    def active(self) -> list[tuple[int, str]]:
        """(slot, selection) of the filled slots; a slot keeps its number."""
        return [(k, s) for k, s in enumerate(self.slots) if s in self.known]

    def moved(self, a: int, b: int, handle: int | None = None) -> QueryParams:
        """Both handles in either order; out of the whole span, the first move picks a single period."""
        if self.is_all and handle is not None:
            a = b = handle
        return replace(self, first=min(a, b), last=max(a, b))

    def within(self, period: Column | str) -> Column:
        return (F.col(period) if isinstance(period, str) else period).between(self.first, self.last)


def period_forms(a: Column, b: Column, span: tuple[int, int]) -> dict[str, Column]:
    """``QueryParams``' forms of a period for columns of two handles, in either order.

    first, last, is_all, single, period_key, label, and ``next``, the one period that the first move of handle a picks.
    """
    first, last = F.least(a, b), F.greatest(a, b)
    is_all = (first == span[0]) & (last == span[1])
    single = F.when(first == last, first)
    return {
        "first": first, "last": last, "is_all": is_all, "single": single,
        "period_key": F.when(is_all, F.lit("all")).otherwise(single.cast("string")),
        "label": F.when(single.isNotNull(), single.cast("string")).otherwise(F.concat_ws("–", first.cast("string"), last.cast("string"))),
        "next": F.when(is_all, a),
    }


def link_of(fragment: Column, known: Column) -> Column:
    """``from_link`` for columns: the selection (one of the array ``known``), "annex", or null."""
    h = F.lower(F.url_decode(F.regexp_replace(fragment, "^#", "")))
    return F.when(F.array_contains(known, h), h).when(h.isin("anexo", "annex"), F.lit("annex"))


def active_slots(slots: Column, known: Column) -> Column:
    """``QueryParams.active`` for columns: (slot, sel) of the filled slots; a slot keeps its number."""
    numbered = F.transform(slots, lambda s, k: F.struct(k.alias("slot"), s.alias("sel")))
    return F.filter(numbered, lambda x: F.array_contains(known, x["sel"]))


def from_link(fragment: str, known: frozenset[str]) -> tuple[str, str] | None:
    """A link's fragment, decoded and case-folded: ("selection", slug), ("annex", "") or nothing."""
    h = unquote(fragment.removeprefix("#")).lower()
    if h in known:
        return ("selection", h)
    return ("annex", "") if h in ("anexo", "annex") else None


def periods(spark, params: QueryParams) -> DataFrame:
    """One row for each period."""
    return spark.range(params.first, params.last + 1).select(F.col("id").cast("int").alias("period"))


def bridge(units: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(sel, slot, unit): a row for each selection that holds the unit; selections may overlap."""
    held = [F.when(rule, F.struct(F.lit(s).alias("sel"), F.lit(k).alias("slot"))) for k, (s, rule) in enumerate(rules.items())]
    return units.select("unit", F.explode(F.array_compact(F.array(*held))).alias("s")).select("s.sel", "s.slot", "unit")


def options(groups: DataFrame, units: DataFrame) -> DataFrame:
    """(sel, unit): groups as g:slug and every unit as a selection of one, c:unit."""
    return groups.select(F.concat(F.lit("g:"), "slug").alias("sel"), "unit").unionByName(
        units.select(F.concat(F.lit("c:"), F.col("unit").cast("string")).alias("sel"), "unit")
    )
