"""Scalar Column expressions (X1-X17). All JVM-side, no Python UDFs.

Each helper takes Columns (or names) and returns a Column, so they compose
inside whole-stage codegen wherever the operators use them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's behaviour.
# Python float() grammar (digits with single underscores, optional fraction and
# exponent, inf/infinity/nan in any case, surrounding blanks).
NUMERIC_PATTERN = (
    r"^\s*[+-]?((([0-9](_?[0-9])*)(\.([0-9](_?[0-9])*)?)?|\.[0-9](_?[0-9])*)"
    r"([eE][+-]?[0-9](_?[0-9])*)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*$"
)
# Observation dates: YYYY, YYYY-MM or YYYY-MM-DD (shape only).
DATE_LITERAL_PATTERN = r"^[0-9]{4}(-[0-9]{2}(-[0-9]{2})?)?$"
# Variable id format: UpperCamelCase segments joined by underscores.
VARIABLE_ID_PATTERN = r"^[A-Z0-9]([A-Za-z0-9]|\.[0-9]+)*(_[A-Z0-9]([A-Za-z0-9]|\.[0-9]+)*)*$"
# Prefixes stripped from variable ids (any case, one of them, once).
VARIABLE_PREFIX_PATTERN = r"(?i)^(dcid:|dcs:)"
# Concept keywords searched in variable names (dataset profile).
CONCEPT_KEYWORDS = ["Count", "Percent", "Median", "Mean", "Amount", "Rate", "Ratio", "Index"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ASCII whitespace, the set of Java's \s
_WS = " \t\n\u000b\f\r"


def strip_blanks(x) -> Column:
    """Trim all ASCII whitespace (plain ``trim`` only removes spaces)."""
    return F.btrim(_c(x), F.lit(_WS))


def is_blank(x) -> Column:
    """NULL or only whitespace."""
    c = _c(x)
    return c.isNull() | (strip_blanks(c) == "")


def _fast_double(t: Column) -> Column:
    """Spark's cast where it agrees with Python float(): it also takes d/f suffixes
    and hex floats, which Python rejects, so those are excluded here."""
    d = t.try_cast("double")
    low = F.lower(t)
    java_suffix = F.substring(t, -1, 1).isin("d", "D", "f", "F") & ~low.endswith("inf")
    return F.when(~java_suffix & ~low.contains("x"), d)


def is_numeric(x) -> Column:
    """Python float() grammar; blank counts as numeric.

    The common case is decided by a cast; only strings the cast rejects and
    that could still be Python floats (digit underscores, signed nan) go
    through the full grammar regex.
    """
    c = _c(x)
    t = strip_blanks(c)
    rare = (t.contains("_") | F.lower(t).contains("nan")) & c.rlike(NUMERIC_PATTERN)
    return is_blank(c) | _fast_double(t).isNotNull() | rare


def to_double(x) -> Column:
    """Parse a cell accepted by X2 (underscores dropped); NULL for blank or non-numeric."""
    c = _c(x)
    t = strip_blanks(c)
    rare = F.when(
        (t.contains("_") | F.lower(t).contains("nan")) & c.rlike(NUMERIC_PATTERN),
        F.regexp_replace(F.regexp_replace(t, "_", ""), "^[+-](?=[nN])", "").try_cast("double"),
    )
    return F.coalesce(_fast_double(t), rare)


def to_number(x) -> Column:
    """Number with thousands commas removed, NULL when it does not parse."""
    return to_double(F.regexp_replace(strip_blanks(_c(x)), ",", ""))


def normalize_variable(x) -> Column:
    """Strip one dcid:/dcs: prefix (any case) and surrounding blanks (no regex per row)."""
    t = strip_blanks(_c(x))
    low = F.lower(t)
    return strip_blanks(
        F.when(low.startswith("dcid:"), F.substring(t, 6, 1 << 30)).when(low.startswith("dcs:"), F.substring(t, 5, 1 << 30)).otherwise(t)
    )


def normalize_stat_type(x) -> Column:
    """X4 + lower case + '-' to '_'."""
    return F.translate(F.lower(normalize_variable(x)), "-", "_")


def date_granularity(x) -> Column:
    """X6: 'YYYY', 'YYYY-MM', 'YYYY-MM-DD' by shape, else NULL."""
    c = strip_blanks(x)
    return (
        F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.lit("YYYY-MM-DD"))
        .when(c.rlike(r"^[0-9]{4}-[0-9]{2}$"), F.lit("YYYY-MM"))
        .when(c.rlike(r"^[0-9]{4}$"), F.lit("YYYY"))
    )


def parse_partial_date(x) -> Column:
    """Try the first 10, then 7, then 4 characters as a date (falls back by truncation)."""
    c = strip_blanks(x)
    return F.coalesce(
        F.when(F.length(c) >= 10, F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")),
        F.when(F.length(c) >= 7, F.try_to_date(F.substring(c, 1, 7), "yyyy-MM")),
        F.when(F.length(c) >= 4, F.try_to_date(F.substring(c, 1, 4), "yyyy")),
    )


def period_days(x) -> Column:
    """ISO duration prefix P[nY][nM][nD] -> days with Y=365, M=30, D=1; 0 or unparseable -> NULL."""
    c = F.upper(strip_blanks(x))
    pat = r"^P(([0-9]+)Y)?(([0-9]+)M)?(([0-9]+)D)?"
    y = F.regexp_extract(c, pat, 2)
    m = F.regexp_extract(c, pat, 4)
    d = F.regexp_extract(c, pat, 6)

    def part(p, k):
        return F.when(p != "", p.cast("bigint") * k).otherwise(F.lit(0))

    days = part(y, 365) + part(m, 30) + part(d, 1)
    return F.when(c.startswith("P") & (days > 0), days)


def period_months(x) -> Column:
    """Whole-month length of a period made of years and months only (P1M, P3M, P1Y), else NULL."""
    c = F.upper(strip_blanks(x))
    pat = r"^P(([0-9]+)Y)?(([0-9]+)M)?$"
    ok = c.rlike(pat) & (c != "P")
    y = F.regexp_extract(c, pat, 2)
    m = F.regexp_extract(c, pat, 4)
    months = F.when(y != "", y.cast("bigint") * 12).otherwise(0) + F.when(m != "", m.cast("bigint")).otherwise(0)
    return F.when(ok & (months > 0), months)


def percent_change(prev, curr) -> Column:
    """(curr - prev) / |prev| * 100, NULL when |prev| < 1e-9."""
    p, c = _c(prev), _c(curr)
    return F.when(F.abs(p) >= F.lit(1e-9), (c - p) / F.abs(p) * F.lit(100.0))


def variable_suffix_keys(x) -> Column:
    """Keys under which a variable value matches a sample's variable.

    A value v matches a sample s when v == s or v ends with ':'+s or '/'+s, so
    the keys of v are v itself and every remainder after a ':' or '/'.
    """
    c = strip_blanks(x)
    pieces = F.split(c, r"(?<=[:/])")
    n = F.size(pieces)
    tails = F.transform(
        F.sequence(F.lit(2), F.greatest(n, F.lit(2))),
        lambda i: F.array_join(F.slice(pieces, i, n), ""),
    )
    return F.array_distinct(F.concat(F.array(c), F.filter(tails, lambda t: (t != F.lit("")) & (n >= 2))))


def unit_display(x) -> Column:
    """X11: '[]' or blank -> '(missing)', '[a, b]' -> 'a, b', other text as is."""
    s = strip_blanks(x)
    inner = F.regexp_replace(F.regexp_replace(s, r"^\[", ""), r"\]*$", "")
    parts = F.filter(F.transform(F.split(inner, ","), lambda p: strip_blanks(p)), lambda p: p != "")
    listed = F.when(F.size(parts) == 0, F.lit("(missing)")).otherwise(F.array_join(parts, ", "))
    return (
        F.when(s.isNull() | (s == "") | (s == "—") | (s == "[]"), F.lit("(missing)"))
        .when(s.startswith("["), listed)
        .otherwise(s)
    )


def row_display(map_col) -> Column:
    """X12: 'k: v, k: v' of a map<string,string>, variable columns left out, NULL value as '—'."""
    m = F.map_filter(_c(map_col), lambda k, v: ~k.isin("StatVar", "stat_var", "statVar"))
    entries = F.transform(
        F.map_entries(m), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("—")))
    )
    return F.when(F.size(entries) == 0, F.lit("—")).otherwise(F.array_join(entries, ", "))


def render_list(arr) -> Column:
    """Serialized list text: '[]', '[a]', '[a, b]' from a sorted array, never NULL."""
    return F.concat(F.lit("["), F.array_join(F.array_sort(F.coalesce(_c(arr), F.array().cast("array<string>"))), ", "), F.lit("]"))


def concepts_found(x, keywords=None) -> Column:
    """Sorted keywords contained (case-insensitive) in the text."""
    kws = sorted(keywords or CONCEPT_KEYWORDS)
    arr = F.array(*[F.lit(k) for k in kws])
    low = F.lower(_c(x))
    return F.filter(arr, lambda k: F.instr(low, F.lower(k)) > 0)


def dataset_id_from_folder(x) -> Column:
    """Lower-case, non [a-z0-9] runs -> '-', trimmed of '-', cut at 48; short -> 'ds-' + sha256[:8]."""
    low = F.lower(strip_blanks(x))
    slug = F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.regexp_replace(F.substring(slug, 1, 48), "-+$", "")
    return F.when(F.length(cut) < 3, F.concat(F.lit("ds-"), F.substring(F.sha2(strip_blanks(x), 256), 1, 8))).otherwise(cut)
