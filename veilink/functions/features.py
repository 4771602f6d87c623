"""Feature strings of columns, as Column expressions.

Each function takes a column and gives ``array<string>``; none of them is a Python UDF except the phonetic codes. A feature
factory maps a column type to such a function.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .phonetic import double_metaphone_codes

# Fixed value: what counts as white space (the Unicode spaces and the separators below 0x20), for Java and RE2 alike.
SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SEPARATORS = rf"[{SPACE}+\-_,.]+"

Feature = Callable[[Column], Column]


def no_features() -> Column:
    return F.array().cast("array<string>")


def case_folded(c: Column) -> Column:
    """Full case folding: letters that fold to several first (only where a value has one), the others by way of upper case. The
    dotless i, which has no folding, is kept."""
    several = {x: x.casefold() for x in map(chr, range(0x80, 0xFB18)) if len(x.casefold()) > 1}
    long = c
    for x, y in several.items():
        long = F.replace(long, F.lit(x), F.lit(y))
    c = F.when(c.rlike("[" + "".join(several) + "]"), long).otherwise(c)
    return F.translate(F.lower(F.upper(F.translate(c, "ı", "\ue000"))), "ς\ue000", "σı")


def tokens(c: Column) -> Column:
    """``_word_`` of each word between separators; null gives no tokens."""
    words = F.filter(F.split(F.coalesce(c, F.lit("")), SEPARATORS), lambda w: w != "")
    return F.transform(words, lambda w: F.concat(F.lit("_"), w, F.lit("_")))


def ngrams(toks: Column, lengths: Sequence[int] = (2, 3)) -> Column:
    """All substrings of the given lengths of each token, length by length; the gram ``_`` alone is left out."""

    def of_length(n: int) -> Column:
        def grams(t: Column) -> Column:
            some = F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, n))
            return F.when(F.length(t) >= n, some).otherwise(no_features())

        return F.flatten(F.transform(toks, grams))

    if not lengths:
        return no_features()
    return F.filter(F.concat(*[of_length(n) for n in lengths]), lambda g: g != "_")


def skip_grams(toks: Column) -> Column:
    """Each token's pairs of characters with one between them."""

    def grams(t: Column) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: F.concat(F.substring(t, i, 1), F.substring(t, i + 2, 1)))
        return F.when(F.length(t) >= 3, some).otherwise(no_features())

    return F.flatten(F.transform(toks, grams))


def string_features(
    c: Column, ngram_length: Sequence[int] = (2, 3), use_gen_ngram: bool = True, use_gen_skip_grams: bool = False, use_double_metaphone: bool = False
) -> Column:
    """n-grams, then skip-grams, then phonetic codes of the lower-case string. Null is an empty string."""
    low = F.lower(F.coalesce(c, F.lit("")))
    toks = tokens(low)
    parts = [ngrams(toks, ngram_length)] if use_gen_ngram is True else []
    if use_gen_skip_grams is True:
        parts.append(skip_grams(toks))
    if use_double_metaphone is True:
        parts.append(double_metaphone_codes(low))
    return F.concat(*parts) if parts else no_features()


def name_features(**options) -> Feature:
    """Names; null and empty ones have no features."""
    return lambda c: string_features(c.cast("string"), **options)


def sex_features() -> Feature:
    """``sex<x>`` by the case-folded first character. What is missing gives one empty string, which is hashed like any other
    feature: two missing values agree. For a column that isn't a string, pass null."""

    def of(c: Column) -> Column:
        return F.array(F.coalesce(F.concat(F.lit("sex<"), F.nullif(F.substring(case_folded(c), 1, 1), F.lit("")), F.lit(">")), F.lit("")))

    return of


def date_features(dayfirst: bool = True, yearfirst: bool = False, default: Sequence[str] = (), formats: Sequence[str] | None = None) -> Feature:
    """``day<dd>``, ``month<mm>``, ``year<yyyy>`` by the first format that parses, else ``default``.

    Every row is read on its own, so the result doesn't depend on the order of rows.
    """
    if isinstance(default, str):
        raise TypeError("default must be a list of strings")
    if formats is None:
        short = ["d/M/y", "d.M.y", "d-M-y"] if dayfirst else ["M/d/y", "M.d.y", "M-d-y"]
        long = ["y/M/d", "y-M-d"]
        formats = [*(long if yearfirst else short), *(short if yearfirst else long), "d MMM y"]

    def of(c: Column) -> Column:
        text = F.trim(c.cast("string"))
        day = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])
        parts = [F.concat(F.lit(f"{n}<"), F.date_format(day, f), F.lit(">")) for n, f in (("day", "dd"), ("month", "MM"), ("year", "yyyy"))]
        return F.when(day.isNotNull(), F.array(*parts)).otherwise(F.array(*map(F.lit, default)).cast("array<string>"))

    return of


def misc_features(label: str = "misc") -> Feature:
    """``label<value>`` of the case-folded value; null, empty and ``no_data`` have none."""

    def of(c: Column) -> Column:
        value = case_folded(c.cast("string"))
        return F.when(value.isNull() | value.isin("", "no_data"), no_features()).otherwise(F.array(F.concat(F.lit(f"{label}<"), value, F.lit(">"))))

    return of


def shingled_features(ngram_length: Sequence[int] = (2, 3), use_gen_skip_grams: bool = False, label: str = "zz") -> Feature:
    """n-grams (and skip-grams), each as ``label<gram>``."""

    def of(c: Column) -> Column:
        grams = string_features(c.cast("string"), ngram_length, True, use_gen_skip_grams)
        return F.transform(grams, lambda g: F.concat(F.lit(f"{label}<"), g, F.lit(">")))

    return of


#: Column types by name; a function that takes ``label`` gets the column's name unless one is given.
FACTORY: dict[str, Callable[..., Feature]] = {
    "name": name_features, "sex": sex_features, "dob": date_features, "misc": misc_features, "shingled": shingled_features,
}
