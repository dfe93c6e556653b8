"""Scalar text functions as Columns: everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SOFT_HYPHEN = "­"


def clean(x: Column) -> Column:
    """Unicode whitespace runs to one space, ends stripped."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def normalise_markup(x: Column) -> Column:
    """A line feed with its indent is one space, runs of blanks one; all-blank text with a line feed is empty."""
    one = F.regexp_replace(F.regexp_replace(x, r"[ \t]*\r?\n\s*", " "), r"[ \t]+", " ")
    return F.when(F.regexp_like(x, F.lit(r"(?U)^\s*\n\s*$")), "").otherwise(one)


def join_soft_hyphens(x: Column) -> Column:
    return F.regexp_replace(x, SOFT_HYPHEN + r"(?U)\s+", SOFT_HYPHEN)


def join_seam(left: Column, right: Column) -> Column:
    """Two text pieces: behind a soft hyphen the right one loses its leading space."""
    return F.concat(left, F.when(left.endswith(SOFT_HYPHEN), F.regexp_replace(right, r"(?U)^\s+", "")).otherwise(right))


def first_text(items: Column) -> Column:
    """The first item of an array, stripped; empty if there is none."""
    return F.coalesce(strip(F.try_element_at(items, F.lit(1))), F.lit(""))


def note_id(x: Column) -> Column:
    return F.translate(x, "-.", "__")


def lemma_markers(a: Column, style: str) -> Column:
    return {"open": F.concat(a, F.lit("-")), "close": F.concat(F.lit("-"), a)}.get(style, F.concat(a, F.lit("-"), a))


def file_stem(x: Column) -> Column:
    return F.regexp_replace(x, r"[/\\]", "-")


def humanise(x: Column) -> Column:
    spaced = F.regexp_replace(x, "[_-]", " ")
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, 2, 1 << 30))


def tighten_punctuation(x: Column) -> Column:
    return F.regexp_replace(x, r"\s+([.,;:])", "$1")


def strip_markup(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"(?s)<!--.*?-->", ""), r"(?s)<[^>]*>", "")


def markdown_finish(x: Column) -> Column:
    """Three or more line feeds to two; empty emphasis removed; a blank line behind HTML blocks."""
    x = F.regexp_replace(x, r"\n{3,}", "\n\n")
    x = F.regexp_replace(F.regexp_replace(x, r"_ _", " "), r"\*\* \*\*", " ")
    return F.regexp_replace(x, r"(</(?:table|dl|div|figure)>)\n(?!\n)", "$1\n\n")


def typst_escape(x: Column) -> Column:
    x = F.regexp_replace(x, r"([\\#$@*_\[\]<`~(])", r"\\$1")
    x = F.regexp_replace(x, r"^\.", r"\\.")
    x = F.regexp_replace(x, r"(?m)^([=+/-])", r"\\$1")
    return F.regexp_replace(x, "//", r"\\/\\/")


def typst_length(css: str) -> str:
    """A CSS length for Typst: pixels become points (3/4), other units pass."""
    return f"{float(css[:-2]) * 0.75:g}pt" if css.endswith("px") else css


def slug(x: Column) -> Column:
    """An identifier of at most 60 characters: accents of Latin letters folded, letters kept, no leading digit."""
    plain = F.translate(F.lower(x), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    base = F.regexp_replace(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    base = F.regexp_replace(F.substring(base, 1, 60), "-+$", "")
    return F.when(F.regexp_like(base, F.lit("^[0-9]")), F.concat(F.lit("s-"), base)).otherwise(base)


def safe_id(x: Column) -> Column:
    base = F.regexp_replace(x, r"[^A-Za-z0-9_.-]", "-")
    return F.when(F.regexp_like(base, F.lit("^[A-Za-z_]")), base).otherwise(F.concat(F.lit("id-"), base))


def placeholders(pattern: Column, values: dict[str, Column]) -> Column:
    """``{name}`` replaced for known names; unknown ones stay."""
    for name, value in values.items():
        pattern = F.replace(pattern, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return pattern


def parameter_key(values: Column) -> Column:
    """``name=value`` pairs of a map, sorted by name, joined with ``&``."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(values)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "&")


def sort_letter(ident: Column) -> Column:
    """The catalogue letter of an identifier, class prefixes ignored; others than letters share ``#``."""
    first = F.upper(F.substring(F.regexp_replace(ident, r"^(att|model|macro|teidata)\.", ""), 1, 1))
    return F.when(F.regexp_like(first, F.lit(r"^\p{L}$")), first).otherwise("#")


def apparatus_letter(n: Column) -> Column:
    """Letters a to z without j, cycling."""
    letters = F.array(*[F.lit(c) for c in "abcdefghiklmnopqrstuvwxyz"])
    return F.element_at(letters, ((n - 1) % 25 + 1).cast("int"))


def content_hash(x: Column) -> Column:
    return F.substring(F.sha1(x), 1, 16)


def stable_id(stem: Column, xml_id: Column, scope: Column, path: Column) -> Column:
    """``stem#id``, or ``stem#`` and 12 digits of the SHA-1 of scope and path where there is no id."""
    return F.concat(stem, F.lit("#"), F.coalesce(xml_id, F.substring(F.sha1(F.concat_ws("|", scope, path)), 1, 12)))
