"""Text that looks the same but differs in its characters, brought to one form.

A value is first cleaned of what can't be seen or is only another code for the same glyph: compatibility forms (width,
ligatures, roman numerals, letter-like signs), decomposed accents, invisible characters, other spaces and hyphens.
Then each token's dominant script is found, and look-alike letters of other scripts are replaced by the dominant script's,
only in tokens that mix scripts and only if the result stands in the vocabulary. A token wholly of look-alikes is
tried in the other scripts the same way; a token that is itself in the vocabulary is left alone.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of letters that look alike, as (Latin, Greek, Cyrillic, others); a space where a script has none.
LOOKALIKES = (
    "AΑА ", "BΒВ ", "C СϹ", "EΕЕ ", "HΗН ", "IΙІӀ", "J ЈͿ", "KΚК ", "MΜМ ", "NΝ  ", "OΟОՕ", "PΡР ", "S ЅՏ", "TΤТ ", "XΧХ ", "YΥҮ ", "ZΖ  ",
    "Q Ԛ ", "W Ԝ ", "L  Լ", "G ԌԌ", "U  Ս", "a а ", "c сϲ", "d ԁ ", "e е ", "g  ɡ", "h һհ", "i і ı", "j јϳ", "l ӏ ", "n  ո", "oοоօ", "p р ", "q ԛգ",
    "s ѕ ", "uυ ս", "vνѵ ", "w ԝ ", "x х ", "yγуү", "kκк ", "ß  β", "æ ӕ ", "Æ Ӕ ", "ə ә ", "Φ Ф ", "Γ Г ", "Λ Л ", "Π П ", "ГΓ  ", "ФΦ  ", "ПΠ  ",
    "іι  ", "рρ  ", "тτ  ", "пπ  ", "фφ  ", "ë ё ", "Ë Ё ", "ï ї ", "Ï Ї ", "ÏΪЇ ", "ïϊї ", "óό  ", "ÿ ӱ ", "ă ӑ ", "ä ӓ ", "Ă Ӑ ", "Ä Ӓ ", "ö ӧ ", "Ö Ӧ ", "ĕ ӗ ",
)
HYPHENS = "‐‑‒–−﹣－­"
APOSTROPHES = "’ʼ‘ʹ＇′"
INVISIBLE_MARKS = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
SCRIPTS = ("LATIN", "GREEK", "CYRILLIC", "ARMENIAN")


@lru_cache(maxsize=65536)
def script_of(ch: str) -> str:
    """Script of a letter by its Unicode name; empty for what belongs to all scripts."""
    if not ch.isalpha():
        return ""
    return unicodedata.name(ch, "").split(" ")[0]


@lru_cache(maxsize=1)
def variants() -> dict[str, dict[str, str]]:
    """Letter -> script -> the letter of that script that looks like it."""
    table: dict[str, dict[str, str]] = {}
    for row in LOOKALIKES:
        letters = [c for c in row if c != " "]
        for c in letters:
            for other in letters:
                if other != c:
                    table.setdefault(c, {}).setdefault(script_of(other), other)
    return table


def visible_form(value: str) -> str:
    """``value`` without what can't be seen: invisible characters gone, one kind of space, hyphen and apostrophe, composed."""
    if value.isascii() and value.isprintable():
        return value.strip(" ")
    kept = []
    for ch in unicodedata.normalize("NFKC", "".join("-" if c in HYPHENS[:-1] else c for c in value)):
        if ord(ch) in INVISIBLE_MARKS or unicodedata.category(ch) in ("Cf", "Cc") and not ch.isspace():
            continue
        kept.append(" " if ch.isspace() or unicodedata.category(ch) == "Zs" else "-" if ch in HYPHENS[:-1] else "'" if ch in APOSTROPHES else "g" if ch == "ɡ" else ch)
    return unicodedata.normalize("NFC", " ".join("".join(kept).split(" ")).strip(" "))


def in_script(token: str, script: str) -> str | None:
    """``token`` with every letter in ``script``; None if a letter has no look-alike there."""
    made = []
    for ch in token:
        own = script_of(ch)
        if own in ("", script):
            made.append(ch)
            continue
        base, *marks = unicodedata.normalize("NFD", ch)
        other = variants().get(ch, {}).get(script)
        if other is None and (letter := variants().get(base, {}).get(script)):
            other = unicodedata.normalize("NFC", letter + "".join(marks))
        if other is None:
            return None
        made.append(other)
    return unicodedata.normalize("NFC", "".join(made))


def forms_of(token: str) -> list[str]:
    """A token's possible forms, the dominant script's first."""
    scripts = [script_of(c) for c in token if script_of(c)]
    if not scripts:
        return [token]
    ranked = sorted(SCRIPTS, key=lambda s: (-scripts.count(s), SCRIPTS.index(s)))
    made = dict.fromkeys(f for s in ranked if (f := in_script(token, s)) is not None)
    return list(made) or [token]


@lru_cache(maxsize=1)
def classes() -> dict[str, str]:
    """Letter -> the first letter of all that look like it, directly or through others."""
    first: dict[str, str] = {}

    def top(c: str) -> str:
        while first.get(c, c) != c:
            c = first[c]
        return c

    for row in LOOKALIKES:
        letters = [unicodedata.normalize("NFD", c)[0] for c in row if c != " "]
        for c in letters[1:]:
            low, high = sorted((top(letters[0]), top(c)))
            first[high] = low
    return {c: top(c) for c in first}


def skeleton(seen: str) -> str:
    """One text for all visible forms that differ by look-alike letters only: equal where a repair is possible, and seldom otherwise."""
    same = classes()
    return unicodedata.normalize("NFC", "".join(same.get(c, c) for c in unicodedata.normalize("NFD", seen)))


def tokens_of(seen: str) -> list[str]:
    """Runs between spaces, hyphens and apostrophes, and these."""
    return re.findall(r"[^ \-']+|[ \-']", seen)


def repair_rank(seen: str, listed: str) -> tuple[int, ...] | None:
    """Which of its forms each token of ``seen`` must take to give ``listed``, the dominant script's form being 0; None if that can't be."""
    mine, theirs = tokens_of(seen), tokens_of(listed)
    if len(mine) != len(theirs):
        return None
    rank = []
    for a, b in zip(mine, theirs):
        forms = forms_of(a)
        if b not in forms:
            return None
        rank.append(forms.index(b))
    return tuple(rank)


def repair(value: str | None, vocabulary: set[str] | frozenset[str]) -> str | None:
    """The form of ``value`` that stands in ``vocabulary``, or its visible form if none does. Null stays null.

    Each token has at most one form for each script; of several listed forms the one counts whose tokens are nearest to their dominant scripts,
    from the first token on.
    """
    if value is None or value in vocabulary:
        return value
    seen = visible_form(value)
    if seen in vocabulary:
        return seen
    bones = skeleton(seen)
    fits = [(rank, name) for name in vocabulary if skeleton(name) == bones and (rank := repair_rank(seen, name)) is not None]
    return min(fits)[1] if fits else seen


def repair_values(values: DataFrame, vocabulary: DataFrame, *, value: str = "value", group: str = "kind", listed: str = "listed_name") -> DataFrame:
    """Distinct (``group``, ``value``) with ``repaired``: the consistent form, as ``repair`` gives it.

    ``vocabulary`` has (``group``, ``listed``) and may be of any size: values meet the listed names that have the same skeleton by a join, and no table goes
    to all executors. Null values are left out, empty ones give an empty form; repeated rows give one row. Values of a group without
    vocabulary only get their visible form.
    """

    @F.pandas_udf("struct<seen:string,bones:string>")
    def looks(v: pd.Series) -> pd.DataFrame:
        seen = [visible_form(x) for x in v]
        return pd.DataFrame({"seen": seen, "bones": [skeleton(x) for x in seen]})

    @F.pandas_udf("array<int>")
    def ranked(seen: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([None if n is None else [-1] if n == s else repair_rank(s, n) for s, n in zip(seen, name)], dtype=object)

    distinct = values.select(group, value).where(F.col(value).isNotNull()).distinct().withColumn("_looks", looks(F.col(value))).select(group, value, "_looks.seen", "_looks.bones")
    names = vocabulary.select(F.col(group).alias("_group"), F.col(listed).alias("_listed")).where(F.col("_listed").isNotNull()).distinct().withColumn("_looks", looks(F.col("_listed")))
    names = names.select("_group", "_listed", F.col("_looks.bones").alias("_bones"))
    met = distinct.join(names, (F.col(group) == F.col("_group")) & (F.col("bones") == F.col("_bones")), "left")
    # a value that is listed as it stands stays; else its visible form, if listed; else the best form
    tried = met.withColumn("_rank", F.when(F.col("_listed") == F.col(value), F.array(F.lit(-2))).otherwise(ranked(F.col("seen"), F.col("_listed")).cast("array<int>")))
    best = F.min(F.when(F.col("_rank").isNotNull(), F.struct(F.col("_rank"), F.col("_listed"))))
    return tried.groupBy(group, value).agg(best.alias("_best"), F.first("seen").alias("_seen")).select(group, value, F.coalesce("_best._listed", "_seen").alias("repaired"))


def found_lookalikes(people: DataFrame, name_list: DataFrame, *, key: str = "id", fields: dict[str, str] | None = None) -> DataFrame:
    """(``id``, ``field_name``, ``name_id``): fields that look like a listed name but are other characters.

    Of a name that is listed twice the smallest ``name_id`` counts. A row delivered twice gives one row; if its value
    differs between deliveries, each value that is a case gives its ``name_id``, the smallest one being kept. Nulls give no row.
    """
    fields = fields or {"first_name": "first", "last_name": "last"}
    long = people.select(
        key, F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.lit(k).alias("kind"), F.col(f).cast("string").alias("value")) for f, k in fields.items()])).alias("x")
    ).select(key, "x.*").where(F.col("value").isNotNull())
    names = name_list.where(F.col("listed_name").isNotNull()).groupBy("kind", F.col("listed_name").alias("repaired")).agg(F.min("name_id").alias("name_id"))
    hits = repair_values(long, name_list).where(~F.col("repaired").eqNullSafe(F.col("value"))).join(names, ["kind", "repaired"]).select("kind", "value", "name_id")
    return long.join(hits, ["kind", "value"]).groupBy(key, "field_name").agg(F.min("name_id").alias("name_id"))
