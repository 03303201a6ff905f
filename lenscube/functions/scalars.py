"""Scalar functions: formats, masks, classes and text. All are built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The least share worth a figure, the class steps, the escapes.
TINY = 0.0005
STEPS = (0.01, 0.05, 0.1, 0.2)
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))
DASH = "–"
NO_BREAK = "\u00a0"  # the space that a line doesn't break at
# The words between listed items, by language and kind; in Spanish before a like sound the other form.
LISTS = {("en", "conjunction"): "and", ("en", "disjunction"): "or", ("es", "conjunction"): "y", ("es", "disjunction"): "o"}
BEFORE_SOUND = {("es", "conjunction"): ("e", "^(?i)(i|hi(?![ae]))"), ("es", "disjunction"): ("u", "^(?i)(o|ho|8|11( |$))")}


def missing_is_null(v: Column) -> Column:
    """NaN, the stored form of a missing share, as NULL."""
    return F.nanvl(v.cast("double"), F.lit(None).cast("double"))


def _missing(v: Column) -> Column:
    return v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))


def decimal_text(v: Column, lang: str = "en", places: int = 1) -> Column:
    """A number with fixed decimals, half away from zero by its shortest decimal form, grouped as the language does.

    Spanish groups from five digits on; both keep the sign of what rounds to zero.
    """
    v = v.cast("double")
    rounded = F.round(v, places)
    text = F.concat(F.when((v < 0) & (rounded == 0), "-").otherwise(""), F.format_number(F.when(rounded == 0, 0.0).otherwise(rounded), places))
    if lang != "es":
        return text
    return F.when(F.abs(rounded) < 10_000, F.translate(text, ".,", ",")).otherwise(F.translate(text, ",.", ".,"))


def percent_text(v: Column, lang: str = "en") -> Column:
    """One decimal of a hundred; a dash for missing; under TINY but not 0 as less than a tenth."""
    sign = f"{NO_BREAK}%" if lang == "es" else "%"
    least = "<0,1" if lang == "es" else "<0.1"
    shown = F.when((v > 0) & (v < TINY), F.lit(least)).otherwise(decimal_text(v * 100, lang))
    return F.when(_missing(v), F.lit(DASH)).otherwise(F.concat(shown, F.lit(sign)))


def ratio_text(v: Column, lang: str = "en") -> Column:
    return F.when(_missing(v), F.lit(DASH)).otherwise(F.concat(decimal_text(v, lang), F.lit("×")))


def whole_percent(v: Column) -> Column:
    """Half up."""
    return F.floor(v * 100 + 0.5).cast("long")


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """{name} by its value, unknown names and null values by nothing; what a value holds is not looked at again."""
    name = r"\{(\w+)\}"
    between, asked = F.split(template, name, -1), F.regexp_extract_all(template, F.lit(name), F.lit(1))
    if not values:
        return F.array_join(between, "")
    known = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.coalesce(v.cast("string"), F.lit("")))])
    return F.array_join(F.zip_with(between, asked, lambda b, n: F.concat(b, F.coalesce(F.element_at(known, n), F.lit("")))), "")


def message(strings: Column, key: str, values: dict[str, Column] | None = None) -> Column:
    """A string table's entry with its values; a missing key stands for itself."""
    return fill_template(F.coalesce(F.element_at(strings, key), F.lit(key)), values or {})


def html_escaped(v: Column) -> Column:
    for raw, shown in ESCAPES:
        v = F.replace(v, F.lit(raw), F.lit(shown))
    return v


def in_sentence(v: Column) -> Column:
    """The first letter small where a small one follows it; acronyms stay."""
    return F.when(v.rlike(r"^\p{Lu}\p{Ll}"), F.concat(F.lower(F.substring(v, 1, 1)), F.substr(v, F.lit(2)))).otherwise(v)


def listed(items: Column, lang: str = "en", kind: str = "conjunction") -> Column:
    """a, b, and c (English) or a, b y c (Spanish); kind is conjunction or disjunction."""
    n, last = F.size(items), F.element_at(items, -1)
    word = F.lit(LISTS[lang, kind])
    if (lang, kind) in BEFORE_SOUND:
        other, sound = BEFORE_SOUND[lang, kind]
        word = F.when(last.rlike(sound), other).otherwise(word)
    head = F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(0))), ", ")
    comma = F.when(n > 2, ",").otherwise("") if lang == "en" else F.lit("")
    return F.when(n == 0, F.lit("")).when(n == 1, F.get(items, F.lit(0))).otherwise(F.concat(head, comma, F.lit(" "), word, F.lit(" "), last))


def bucket(v: Column, steps: tuple[float, ...] = STEPS) -> Column:
    """How many steps are at most ``v``; NULL for missing, NaN included."""
    return F.when(v.isNotNull() & ~F.isnan(v.cast("double")), sum(((v >= s).cast("long") for s in steps), F.lit(0).cast("long")))


def clamp01(v: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))


def on_lens(mask: Column, lens: int | None) -> Column:
    """Whether a point is on a lens, or on any with None; 16 lenses at most."""
    return mask.bitwiseAND(F.lit(0xFFFF if lens is None else 1 << lens)) != 0


def lens_names(mask: Column, names: list[str], most: int = 2) -> Column:
    """The names of a mask's first lenses, in bit order."""
    held = F.array_compact(F.array(*[F.when(mask.bitwiseAND(F.lit(1 << k)) != 0, F.lit(n)) for k, n in enumerate(names)]))
    return F.slice(held, 1, most)


def with_parents(mask: Column, parents: dict[int, int]) -> Column:
    """A sub-topic's bit sets its parent's."""
    for child, parent in parents.items():
        mask = F.when(mask.bitwiseAND(F.lit(1 << child)) != 0, mask.bitwiseOR(F.lit(1 << parent))).otherwise(mask)
    return mask


def is_approximate(lens_is_all: Column, passed: Column) -> Column:
    """Only a failed bar marks a lens; no result yet does not."""
    return ~lens_is_all & F.coalesce(passed == F.lit(False), F.lit(False))


def adjudicated(a: Column, b: Column, third: Column) -> Column:
    """Two readers' answer, or the third's where they differ."""
    return F.when(a.eqNullSafe(b), a).otherwise(third)
