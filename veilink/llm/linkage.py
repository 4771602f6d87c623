"""Matching entities of two tables that share no key: probabilistic record linkage.

Several passes of blocking bring records together that agree on part of their attributes and whose dates of birth don't exclude each
other; each pair becomes a pattern of agreement levels; expectation-maximisation over the counts of patterns gives each level's probability
among matches and among others; the posterior of a pair's pattern is its confidence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import mapped, packed, release
from .people import LEFT, RIGHT, Nicknames, born_level, born_number, county_level, date_or_none, ends, hashed, key_pairs, name_levels, standard_people, with_namesakes

LEVELS = {"name": 7, "born": 5, "sex": 3, "instrument": 3, "county": 3}
RARITIES = 32  # classes of rarity, in bits


TURNS = ("a", "b", "c", "dynp")  # kinds of keys that are on disk at a time: about as many each


def blocking_keys(batches: Iterator[pd.DataFrame], nicknames: Nicknames, left: bool, kinds: str) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, id, born, side): keys of the passes ``kinds``, as hashes.

    A name part counts by the beginning of its sound or of that of its full forms, another one beside it by its first or last letters, so that one slip
    doesn't part two records. Keys of a whole date, and of a part and another with two parts of a date, are for all pairs. In
    the others only pairs meet of which one lacks something: another name part, the month, or the year (then two parts, or a part with the
    place): ``0`` keys are of such records on the left and of all on the right, ``1`` keys of the other way round.
    """
    for b in batches:
        for lo in range(0, len(b), 8000):  # bounds the keys held at once
            ids, keys, dates = [], [], []
            for i, toks, initials, y, m, d, inst, cty in b[["id", "toks", "initials", "y", "m", "d", "instrument", "county"]].iloc[lo : lo + 8000].itertuples(index=False, name=None):
                y, m, d = date_or_none(y, m, d)
                canon = {t: nicknames.canonical(t) for t in toks}
                mine, open_ = set(), []  # keys of all pairs; keys of pairs with an open record, and whether this one is
                if "d" in kinds and None not in (y, m, d):
                    mine.add(f"d{y}.{min(m, d)}.{max(m, d)}")
                halves = [f"{kind}{p}.{q}" for kind, p, q in (("a", y, m), ("b", y, d), ("c", m, d)) if kind in kinds and None not in (p, q)]
                for t in toks:
                    heads = {x[:4] for x in canon[t]}
                    others = {z for u in toks if u != t for z in canon[u]}
                    letters = {e for z in others for e in ends(z)}
                    for half in halves:
                        mine.update(f"{half}.{x}.{e}" for x in heads for e in letters)
                        open_ += [(f"{half}.{x}", not others) for x in heads]
                    if "y" in kinds and y is not None:
                        open_ += [(f"y{x}.{y}", m is None) for x in heads]
                    if "n" in kinds:
                        open_ += [(f"n{x}.{z}", y is None) for x in canon[t] for z in {z[:4] for z in others}]
                    if "p" in kinds and cty:
                        open_ += [(f"p{x}.{cty[:3]}.{inst}", y is None) for x in canon[t]]
                for k, lacks in open_:
                    mine.update(f"{side}{k}" for side in ((("0",) if lacks else ("1",)) if left else (("0", "1") if lacks else ("0",))))
                ids += [i] * len(mine)
                keys += [hashed(k) for k in mine]
                dates += [(y or 0) * 10000 + (m or 0) * 100 + (d or 0)] * len(mine)
            yield np.array(keys, np.int64), np.array(ids, np.int64), np.array(dates, np.int32), np.full(len(keys), LEFT if left else RIGHT)


def read_nicknames(short_names: DataFrame | None) -> list[tuple[str, str]]:
    short = short_names.select("full_form", "short_form").dropna().limit(100_001).collect() if short_names is not None else []
    if len(short) > 100_000:
        raise ValueError("the table of short forms has over 100,000 rows")
    return [(r[0], r[1]) for r in short]


def candidates(left: DataFrame, right: DataFrame, hot_pairs: int = 400_000, nicknames: DataFrame | None = None) -> DataFrame:
    """Distinct (``id``, ``other``) of standard records that share a key and whose dates of birth don't exclude each other. Keys with over
    ``hot_pairs`` pairs are joined in blocks; none is lost, however many share a date or name."""
    shared = left.sparkSession.sparkContext.broadcast(read_nicknames(nicknames))

    def keyed(is_left: bool):
        return lambda kinds: lambda batches: blocking_keys(batches, Nicknames(shared.value), is_left, kinds)

    return key_pairs([(left, keyed(True)), (right, keyed(False))], TURNS, hot_pairs, within=False).distinct()


def described(people: DataFrame, key: str, side: str) -> DataFrame:
    """What a comparison needs of standard records, under names that end in ``side``."""
    name = F.concat(F.array_join("toks", " "), F.lit("|"), F.array_join("initials", " "))
    born = born_number(F.col("y"), F.col("m"), F.col("d"))
    return people.select(F.col("id").alias(key), *[c.alias(f"{n}_{side}") for n, c in (("name", name), ("born", born))], *[F.col(c).alias(f"{c}_{side}") for c in ("sex", "instrument", "county", "namesakes")])


def _plain_level(name: str) -> Column:
    a, b = (F.nullif(F.col(f"{name}_{side}"), F.lit("")) for side in "ab")
    return F.when(a.isNull() | b.isNull(), 1).when(a == b, 2).otherwise(0)


def patterns(pairs: DataFrame, left: DataFrame, right: DataFrame, nicknames: DataFrame | None, namesakes: bool = True) -> DataFrame:
    """Agreement levels of each pair (``id``, ``other``, any more columns) of standard records; with ``namesakes``, ``namesakes_a`` and ``namesakes_b`` besides.

    Dates, sexes and instruments are compared by built-in functions; names and counties in batches, each pair of different values once.
    """
    shared = pairs.sparkSession.sparkContext.broadcast(read_nicknames(nicknames))
    joined = pairs.join(described(left, "id", "a"), "id").join(described(right, "other", "b"), "other")
    rows = joined.select(
        *pairs.columns, "namesakes_a", "namesakes_b", born_level(F.col("born_a"), F.col("born_b")).alias("g_born"), _plain_level("sex").alias("g_sex"), _plain_level("instrument").alias("g_instrument"),
        "name_a", "name_b", "county_a", "county_b",
    )
    kept = [c for c in rows.columns[:-4] if namesakes or c not in ("namesakes_a", "namesakes_b")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nick = Nicknames(shared.value)
        for b in batches:
            na, nb, ca, cb = (b.column(c).to_numpy(zero_copy_only=False) for c in ("name_a", "name_b", "county_a", "county_b"))
            level = name_levels(na, nb, nick) if b.num_rows else np.empty(0, np.int64)
            rare = np.minimum(*(b.column(c).to_numpy() for c in ("namesakes_a", "namesakes_b"))) <= 2
            known: dict = {}
            county = [known[k] if (k := (x, z)) in known else known.setdefault(k, county_level(x, z)) for x, z in zip(ca, cb)]
            made = [pa.array((level + ((level == 5) & rare)).astype(np.int32)), pa.array(county, pa.int32())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *made], [*kept, "g_name", "g_county"])

    kinds = dict(rows.dtypes)
    return mapped(rows, run, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "g_name int", "g_county int"]))


def in_turns(pairs: DataFrame, records: int, compare: Callable[[DataFrame], DataFrame], most_turns: int = 32) -> DataFrame:
    """``compare`` of ``pairs``, by classes of ``other`` in turn, so that descriptions of about two pairs a record are on disk at a time
    (of more, where that takes over ``most_turns``)."""
    turns = int(min(most_turns, max(1, -(-pairs.count() // max(1, 2 * records)))))
    found = None
    for turn in range(turns):
        mine = pairs.where(F.pmod(F.xxhash64("other"), F.lit(turns)) == turn) if turns > 1 else pairs
        some = packed(compare(mine))
        found = some if found is None else found.unionByName(some)
        release(pairs.sparkSession)
    return found


def fit(counts: pd.DataFrame, rounds: int = 200) -> pd.DataFrame:
    """``counts`` (``g_*`` and ``n``) with ``posterior``, by expectation-maximisation of a two-class model.

    It starts from pairs whose names and dates agree as matches. A level that says nothing (missing) has the same probability in both classes. Two
    constraints on the parameters stand for what the classes mean: names that conflict, and dates that exclude each other, have next to no
    probability among matches (relatives share all else, and namesakes the name). A column ``g_rows`` (bits of how many records have the rewriting that
    both names share) counts as one more attribute that depends on the level of the names.
    """
    g = counts[[f"g_{k}" for k in LEVELS]].to_numpy()
    n = counts["n"].to_numpy(float)
    name, born = g[:, 0], g[:, 1]
    # names and dates depend on each other (namesakes, relatives): one joint variable
    cells = LEVELS["name"] * LEVELS["born"]
    never = np.isin(np.arange(cells) // LEVELS["born"], (0, 2)) | (np.arange(cells) % LEVELS["born"] == 0)
    variables = [(name * LEVELS["born"] + born, cells, np.ones(len(n), bool), never)]
    variables += [(g[:, c], LEVELS[k], g[:, c] != 1, np.zeros(LEVELS[k], bool)) for c, k in enumerate(LEVELS) if k in ("sex", "instrument", "county")]
    shared = name * RARITIES + np.minimum(counts["g_rows"].to_numpy(), RARITIES - 1) if "g_rows" in counts else None
    match = np.where((name >= 3) & (born >= 2), 0.9, 0.01)
    match[(name >= 4) & (born >= 3)] = 0.99
    match[(born == 3) & (g[:, 2:] == 0).any(1)] = 0.3  # nearly the same date, and something else differs: left to the rounds
    match[(name == 6) & (born == 1)] = 0.9
    match[never[variables[0][0]]] = 0.001
    for _ in range(rounds):
        share = (n * match).sum() / n.sum()
        log_odds = np.full(len(n), np.log(max(share, 1e-12) / max(1 - share, 1e-12)))
        for values, levels, seen, barred in variables:
            m = np.bincount(values[seen], (n * match)[seen], levels) + 0.1
            u = np.bincount(values[seen], (n * (1 - match))[seen], levels) + 0.1
            ratio = np.log(np.where(barred, 1e-6, m / m.sum())) - np.log(u / u.sum())
            log_odds += np.where(seen, ratio[values], 0.0)
        if shared is not None:
            given = [np.bincount(shared, n * w, LEVELS["name"] * RARITIES).reshape(-1, RARITIES) + 0.5 for w in (match, 1 - match)]
            log_odds += np.subtract(*(np.log(x / x.sum(1, keepdims=True)) for x in given)).ravel()[shared]
        new = 1 / (1 + np.exp(-np.clip(log_odds, -60, 60)))
        if np.abs(new - match).max() < 1e-7:
            break
        match = new
    return counts.assign(posterior=match)


def posterior(found: DataFrame, name: str = "confidence") -> DataFrame:
    """``found`` with the posterior of each row's pattern; the model is fitted on the counts of all patterns."""
    keys = [*[f"g_{k}" for k in LEVELS], *(["g_rows"] if "g_rows" in found.columns else [])]
    counts = found.groupBy(*keys).agg(F.count("*").alias("n")).toPandas()  # at most as many rows as there are patterns
    if not len(counts):
        return found.withColumn(name, F.lit(0.0))
    fitted = found.sparkSession.createDataFrame(fit(counts)[[*keys, "posterior"]].rename(columns={"posterior": name}))
    typed = fitted.select(*[F.col(k).cast("int").alias(k) for k in keys], name)
    return found.join(F.broadcast(typed), keys)


def link_people(df1: DataFrame, df2: DataFrame, short_names: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """(``id``, ``personid``, ``confidence``) of pairs with a confidence of at least ``least``, each once; all pairs count where a person has several ids.

    Null and empty attributes say nothing either way; records without any name part or date come into no block. Rows delivered again
    count once. Extra columns are ignored; an empty table gives no pairs.
    """
    left = packed(with_namesakes(packed(standard_people(df1, "id", ("first_name", "last_name"), "gender", "date_of_birth", "instrument", "county"))))
    right = packed(with_namesakes(packed(standard_people(df2, "personid", ("name",), "sex", "birth_date", "main_instrument", "county"))))
    pairs = candidates(left, right, nicknames=short_names)
    found = in_turns(pairs, left.count() + right.count(), lambda some: patterns(some, left, right, short_names, namesakes=False))
    sure = posterior(found).where(F.col("confidence") >= least)
    return sure.select(F.col("id").cast("int").alias("id"), F.col("other").cast("int").alias("personid"), F.round("confidence", 6).alias("confidence"))
