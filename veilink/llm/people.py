"""Records of people in one standard form, and comparison of two of them attribute by attribute.

Shared by record linkage across tables and by the linking of variant spellings inside one.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..session import mapped, packed, release, shuffle_width

from .lookalike import forms_of, visible_form
from .sets import _mixed

# Titles and suffixes (legal forms of a person's name), particles of surnames, letters that don't decompose, synonyms of instruments,
# endings of pet names.
LEGAL_FORMS = frozenset("dr prof mr mrs ms miss mx sir md phd dphil esq jun jr sen sr jnr snr ii iii iv".split())
PARTICLES = frozenset("von van de di da del dos der den la le ter ten zu zur af av du des".split())
PLAIN = {"ß": "ss", "ø": "o", "ł": "l", "æ": "a", "đ": "d", "ð": "d", "þ": "th", "œ": "o", "ı": "i", "ς": "σ"}
INSTRUMENTS = {"fiddle": "violin", "violoncello": "cello", "squeezebox": "accordion", "archlute": "lute", "xylophone": "marimba", "contrabassoon": "bassoon", "sax": "saxophone", "kit": "drums", "d'amore": "viola"}
DIMINUTIVES = ("sia", "chen", "ita", "ito", "ina", "us", "ie", "ek", "ka", "y", "i", "a", "o")
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
SEXES = {"m": "m", "male": "m", "masc": "m", "man": "m", "f": "f", "female": "f", "fem": "f", "w": "f", "woman": "f"}

STANDARD = "id bigint, written string, toks array<string>, initials array<string>, sex string, y int, m int, d int, instrument string, county string"
STANDARD_TYPES = dict(id=pa.int64(), written=pa.string(), toks=pa.list_(pa.string()), initials=pa.list_(pa.string()), sex=pa.string(), y=pa.int32(), m=pa.int32(), d=pa.int32(), instrument=pa.string(), county=pa.string())


@lru_cache(maxsize=50_000)
def plain(token: str) -> str:
    """Lower-case letters without accents, look-alikes of other scripts made Latin where the token mixes scripts."""
    token = unicodedata.normalize("NFD", forms_of(token)[0].lower())
    token = "".join(PLAIN.get(c, c) for c in token if not unicodedata.combining(c))
    # umlauts written out fall together with those that lost their dots
    return re.sub(r"([aou])e(?=[^aeiou]|$)", r"\1", token)


@lru_cache(maxsize=50_000)
def sound(token: str) -> str:
    """A plain token under spelling rules that keep the sound: k for c, ck, kh, q; i for y; v for w; single letters for double ones."""
    t = re.sub(r"ph", "f", token)
    t = re.sub(r"ck|kh|ch|q|c|k", "k", t).replace("y", "i").replace("w", "v").replace("ie", "i").replace("z", "s")
    return re.sub(r"(.)\1+", r"\1", t)


@lru_cache(maxsize=100_000)
def field_parts(field: str) -> tuple[str, ...]:
    """Plain name parts of one field, without particles, legal forms and numbers."""
    parts = (plain(re.sub(r"[^\w']", "", raw)).replace("'", "") for raw in re.split(r"[\s.,_\-/]+", visible_form(field)))
    return tuple(t for t in parts if t and t not in LEGAL_FORMS and t not in PARTICLES and not t.isdigit())


def split_name(*fields: str | None) -> tuple[list[str], list[str]]:
    """Plain name tokens (surname parts apart, particles and legal forms left out) and initials, of all fields together."""
    parts = dict.fromkeys(t for field in fields if field for t in field_parts(field))
    return [t for t in parts if len(t) > 1], [t for t in parts if len(t) == 1]


@lru_cache(maxsize=50_000)
def read_date(text: str | None) -> tuple[int | None, int | None, int | None]:
    """(year, month, day) of a date in one of the usual orders (day before month); what isn't there or can't be is None."""
    s = (text or "").strip().lower()
    y = m = d = None
    if r := re.fullmatch(r"(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})", s):
        d, m, y = map(int, r.groups())
    elif r := re.fullmatch(r"(\d{4})[/.\-](\d{1,2})[/.\-](\d{1,2})", s):
        y, m, d = map(int, r.groups())
    elif r := re.fullmatch(r"(?:(\d{1,2})\.? )?([a-z]{3})[a-z]*\.? (\d{4})", s):
        d, m, y = int(r[1]) if r[1] else None, MONTHS.get(r[2]), int(r[3])
    elif r := re.fullmatch(r"\d{4}", s):
        y = int(s)
    if m and m > 12 and d and d <= 12:
        m, d = d, m
    return y, m if m and 1 <= m <= 12 else None, d if d and 1 <= d <= 31 else None


@lru_cache(maxsize=50_000)
def read_instrument(text: str | None) -> str | None:
    words = visible_form(text or "").lower().split()
    return INSTRUMENTS.get(words[-1], words[-1]) if words else None


@lru_cache(maxsize=50_000)
def read_county(text: str | None) -> str | None:
    return re.sub(r"[^\w]|^county ", "", visible_form(text or "").lower().removeprefix("county ")) or None


def standard_people(people: DataFrame, key: str, names: tuple[str, ...], sex: str, born: str, instrument: str, county: str) -> DataFrame:
    """One standard row for each key: of rows delivered again the last one by every column's order counts. Null keys are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                k, fields, (s, dob, inst, cty) = row[0], row[1 : 1 + len(names)], row[1 + len(names) :]
                toks, initials = split_name(*fields)
                y, m, d = read_date(dob)
                out.append((k, "\x1f".join(f or "" for f in fields), toks, initials, SEXES.get((s or "").strip(" .").lower()), y, m, d, read_instrument(inst), read_county(cty)))
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out) if out else [()] * len(STANDARD_TYPES), STANDARD_TYPES.values())], list(STANDARD_TYPES))

    cols = [*names, sex, born, instrument, county]
    spread = people.where(F.col(key).isNotNull()).repartition(shuffle_width(people.sparkSession), F.col(key).cast("bigint"))  # the rows are few bytes but much work
    last = spread.groupBy(F.col(key).cast("bigint").alias("id")).agg(F.max(F.struct(*[F.col(c).cast("string").alias(c) for c in cols])).alias("r"))
    return mapped(last.select("id", *[F.col(f"r.{c}") for c in cols]), run, STANDARD)


@lru_cache(maxsize=100_000)
def letters(token: str) -> int:
    """The letters of a token as a set of bits."""
    bits = 0
    for c in token:
        bits |= 1 << (ord(c) & 63)
    return bits


def edits(a: str, b: str, most: int = 2) -> int:
    """Insertions, deletions, changes and swaps of neighbours between two tokens, up to ``most`` + 1."""
    # one edit changes at most two letters of a token's set
    if abs(len(a) - len(b)) > most or (letters(a) ^ letters(b)).bit_count() > 2 * most:
        return most + 1
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, before2, before = row, before, row
        row = [i]
        for j, z in enumerate(b, 1):
            v = last[j - 1] if x == z else last[j - 1] + 1
            if last[j] < v:
                v = min(v, last[j] + 1)
            if row[-1] < v:
                v = min(v, row[-1] + 1)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == z and before2[j - 2] + 1 < v:
                v = before2[j - 2] + 1
            row.append(v)
        if min(row) > most and min(last) > most:
            return most + 1
    return min(row[-1], most + 1)


class Nicknames:
    """Short forms of first names, in plain letters."""

    def __init__(self, pairs: list[tuple[str, str]]):
        self.full: dict[str, set[str]] = {}
        self.levels: dict[tuple[str, str], int] = {}
        for full, short in pairs:
            for f in split_name(full)[0][:1]:
                for s in split_name(short)[0][:1]:
                    self.full.setdefault(s, set()).add(f)

    def canonical(self, token: str) -> set[str]:
        """The sounds of a token and of the names that it is short for."""
        return {sound(token), *(sound(f) for f in self.full.get(token, ()))}

    def level(self, a: str, b: str) -> int:
        """``token_level``, kept for pairs seen before."""
        if (known := self.levels.get((a, b))) is None:
            if len(self.levels) > 500_000:
                self.levels.clear()
            known = self.levels[a, b] = token_level(a, b, self)
        return known

    def same(self, a: str, b: str) -> bool:
        fa, fb = self.full.get(a, ()), self.full.get(b, ())
        return b in fa or a in fb or bool(set(fa) & set(fb))


def token_level(a: str, b: str, nicknames: Nicknames) -> int:
    """3 equal in sound, 2 a nickname, a short form or a typo, 0 different."""
    if a == b or sound(a) == sound(b):
        return 3
    if nicknames.same(a, b):
        return 2
    n = min(len(a), len(b))
    if n >= 3 and (a.startswith(b) or b.startswith(a)):
        return 2
    short, long = sorted((a, b), key=len)
    if any(short.endswith(e) and len(short) - len(e) >= 3 and long.startswith(short[: -len(e)]) for e in DIMINUTIVES):
        return 2
    most = 1 if n <= 4 else 2 if n <= 8 else 3
    if n >= 3 and (edits(a, b, 3) <= most or edits(sound(a), sound(b), 3) <= most):
        return 2
    return 0


def name_level(ta, ia, tb, ib, nicknames: Nicknames) -> tuple[int, list[str]]:
    """How two names agree, and the tokens of the first that are matched.

    5: all tokens of the shorter name are equal in sound, at least two; 4: all match, at least two; 3: one matches and the rest are
    initials that fit or a part that is missing; 2: one matches, others conflict; 1: nothing to compare; 0: conflict.
    """
    if not ta or not tb:
        return 1, []
    left, matched, levels = list(tb), [], []
    graded = sorted(((nicknames.level(a, b), a, b) for a in ta for b in tb), key=lambda x: -x[0])
    used_a: set[str] = set()
    for level, a, b in graded:
        if level and a not in used_a and b in left:
            used_a.add(a)
            left.remove(b)
            matched.append(a)
            levels.append(level)
    rest_a, rest_b = [a for a in ta if a not in used_a], left
    if not matched:
        joined = nicknames.level("".join(ta), "".join(tb))  # a space lost or put in
        return (4, list(ta)) if joined else (0, [])
    fits_a = [a for a in rest_a if any(a.startswith(i) for i in ib)]
    fits_b = [b for b in rest_b if any(b.startswith(i) for i in ia)]
    open_a, open_b = len(rest_a) - len(fits_a), len(rest_b) - len(fits_b)
    if open_a and open_b:
        return 2, matched
    if len(matched) >= 2:
        return (5 if min(levels) == 3 else 4), matched
    if fits_a or fits_b:
        return 3, matched
    # one token in common and nothing against it: the other side lacks a part, or its initial doesn't fit
    if (ib and rest_a and not fits_a) or (ia and rest_b and not fits_b):
        return 2, matched
    return 3, matched


def date_level(a, b) -> int:
    """4 all that both have agrees (a full date); 3 day and month swapped or one part off by a slip; 2 agrees as far as it goes (not full); 1 missing; 0 different."""
    ya, ma, da = a
    yb, mb, db = b
    if ya is None or yb is None:
        return 1
    full = None not in (ma, da, mb, db)
    if not full:
        if ya != yb:
            return 0
        return 2 if ma is None or mb is None or ma == mb else 0
    if (ya, ma, da) == (yb, mb, db):
        return 4
    same = (ya == yb) + (ma == mb) + (da == db)
    if ya == yb and (ma, da) == (db, mb):
        return 3
    if same == 2:
        return 3
    return 0


def born_number(y: Column, m: Column, d: Column) -> Column:
    """A date as one number, year first; parts that are missing are zeros."""
    return (F.coalesce(y, F.lit(0)) * 10000 + F.coalesce(m, F.lit(0)) * 100 + F.coalesce(d, F.lit(0))).cast("int")


def born_level(a: Column, b: Column) -> Column:
    """``date_level`` of two ``born_number`` columns."""
    (ya, ma, da), (yb, mb, db) = (((F.floor(c / 10000)), F.floor(c / 100) % 100, c % 100) for c in (a, b))
    equal = (ya == yb).cast("int") + (ma == mb).cast("int") + (da == db).cast("int")
    partial = F.when((ya == yb) & ((ma == 0) | (mb == 0) | (ma == mb)), 2).otherwise(0)
    whole = F.when(a == b, 4).when((equal == 2) | ((ya == yb) & (ma == db) & (da == mb)), 3).otherwise(0)
    return F.when((ya == 0) | (yb == 0), 1).when((ma == 0) | (da == 0) | (mb == 0) | (db == 0), partial).otherwise(whole)


class _Tokens:
    """Numbers of tokens that tell which pairs of them can't agree."""

    def __init__(self, nicknames: Nicknames):
        self.nicknames, self.text, self.at, self.rows = nicknames, [], {}, []

    def add(self, token: str) -> int:
        if token not in self.at:
            heard = sound(token)
            self.at[token] = len(self.text)
            self.text.append(token)
            self.rows.append((len(token), letters(token), len(heard), letters(heard), hash(heard), hash(token[:3]), token in self.nicknames.full))
        return self.at[token]

    def close(self) -> None:
        columns = list(zip(*self.rows)) if self.rows else [()] * 7
        self.size, self.heard_size = np.array(columns[0], np.int64), np.array(columns[2], np.int64)
        self.bits, self.heard_bits = np.array(columns[1], np.uint64), np.array(columns[3], np.uint64)
        self.heard, self.start, self.short = np.array(columns[4], np.int64), np.array(columns[5], np.int64), np.array(columns[6], bool)

    def may_agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """False where ``token_level`` is surely 0: one edit changes at most two letters of a token's set."""
        n = np.minimum(self.size[a], self.size[b])
        most = np.where(n <= 4, 1, np.where(n <= 8, 2, 3))
        typed = (np.abs(self.size[a] - self.size[b]) <= most) & (np.bitwise_count(self.bits[a] ^ self.bits[b]) <= 2 * most)
        spoken = (np.abs(self.heard_size[a] - self.heard_size[b]) <= most) & (np.bitwise_count(self.heard_bits[a] ^ self.heard_bits[b]) <= 2 * most)
        return typed | spoken | (self.heard[a] == self.heard[b]) | (self.start[a] == self.start[b]) | self.short[a] | self.short[b]


def name_levels(left: np.ndarray, right: np.ndarray, nicknames: Nicknames) -> np.ndarray:
    """``name_level`` of many pairs of names, each written as its tokens and, behind ``|``, its initials.

    Each pair of different names is compared once, and in full only if some of their tokens can agree.
    """
    codes, names = pd.factorize(np.concatenate([left, right]))
    tokens = _Tokens(nicknames)
    parts = [tuple(half.split() for half in name.split("|")) for name in names]
    width = max((len(t) for t, _ in parts), default=0)
    at = np.full((len(parts), width), -1)
    for k, (toks, _) in enumerate(parts):
        at[k, : len(toks)] = [tokens.add(t) for t in toks]
    whole = np.array([tokens.add("".join(toks)) for toks, _ in parts], np.int64)
    tokens.close()
    pairs, back = np.unique(codes[: len(left)] * len(parts) + codes[len(left) :], return_inverse=True)
    a, b = pairs // max(1, len(parts)), pairs % max(1, len(parts))
    may = tokens.may_agree(whole[a], whole[b])
    for i in range(width):
        for j in range(width):
            rows = np.flatnonzero((at[a, i] >= 0) & (at[b, j] >= 0))
            may[rows] |= tokens.may_agree(at[a[rows], i], at[b[rows], j])
    out = np.where((at[a, 0] < 0) | (at[b, 0] < 0), 1, 0) if width else np.ones(len(pairs), np.int64)
    for k in np.flatnonzero(may & (out == 0)):
        (ta, ia), (tb, ib) = parts[a[k]], parts[b[k]]
        out[k] = name_level(ta, ia, tb, ib, nicknames)[0]
    return out[back]


def ends(part: str) -> set[str]:
    """The beginning and the end of a part: two parts that differ by one slip (a letter more, less, changed, or two swapped) share one of them, and a part cut
    short shares the beginning of the whole."""
    if len(part) < 3:
        return {f"^{part}"}
    return {f"^{part[:2]}", *(f"{part[-k:]}$" for k in (1, 2) if k == 1 and len(part) <= 5 or k == 2 and len(part) >= 5), *([f"^{part[0]}"] if len(part) <= 5 else [])}


def hashed(text: str) -> int:
    """A 64-bit key of a text, as Spark's bigint holds it."""
    n = xxhash.xxh3_64_intdigest(text)
    return n - (1 << 64) if n >> 63 else n


LEFT, RIGHT = 1, 2  # bits of the side on which a record stands at a key


def dates_fit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether ``born_level`` of two arrays of ``born_number`` is over 0."""
    (ya, ma, da), (yb, mb, db) = ((x // 10000, x // 100 % 100, x % 100) for x in (a, b))
    year = ya == yb
    partial = year & ((ma == 0) | (mb == 0) | (ma == mb))
    whole = (year.astype(np.int8) + (ma == mb) + (da == db) >= 2) | (year & (ma == db) & (da == mb))
    return (ya == 0) | (yb == 0) | np.where((ma == 0) | (da == 0) | (mb == 0) | (db == 0), partial, whole)


def _dealt(key: np.ndarray, ids: np.ndarray, born: np.ndarray, side: np.ndarray, parts: int) -> tuple[np.ndarray, list[bytes]]:
    """Partitions, and what goes to each: number of entries and, compressed, their columns one after the other."""
    part = (_mixed(key.view(np.uint64)) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    some, first = np.unique(part[order], return_index=True)
    blobs = []
    for at in np.split(order, first[1:]) if len(some) else []:
        columns = (key[at], ids[at], born[at].astype(np.int32), side[at].astype(np.uint8))
        blobs.append(len(at).to_bytes(4, "little") + pa.compress(b"".join(c.tobytes() for c in columns), codec="zstd", asbytes=True))
    return some, blobs


def _taken(blobs: list) -> tuple[np.ndarray, ...]:
    """(key, id, born, side) of what ``_dealt`` has put into a partition."""
    columns: list[list[np.ndarray]] = [[], [], [], []]
    for blob in blobs:
        n = int.from_bytes(bytes(blob[:4]), "little")
        data, at = pa.decompress(blob[4:], 21 * n, codec="zstd", asbytes=True), 0
        for column, kind in zip(columns, (np.int64, np.int64, np.int32, np.uint8)):
            column.append(np.frombuffer(data, kind, n, at))
            at += column[-1].nbytes
    return tuple(np.concatenate(c) for c in columns)


def key_pairs(sides: list[tuple[DataFrame, Callable[[str], Callable]]], turns: tuple[str, ...], hot_pairs: int, within: bool, step: int = 500_000) -> DataFrame:
    """(``id``, ``other``) of records that have a key in common and dates of birth that don't exclude each other, each once or a few times.

    ``sides`` has tables and what makes, of the kinds of keys of a turn, a function of their batches that yields arrays of key, id, born and side. Keys
    are made turn by turn and travel once, so that of the many keys of a record a fraction is on disk at a time. A key with over ``hot_pairs`` pairs
    is cut into blocks of both sides, and each pair of blocks is joined by itself: none is lost, however many share a key.
    ``within``: both sides are of one table; ``id`` < ``other``.
    """
    spark = sides[0][0].sparkSession
    parts = shuffle_width(spark)

    def lay(make: Callable) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for columns in make(b.to_pandas() for b in batches):
                part, blobs = _dealt(*columns, parts)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(blobs, pa.binary())], ["part", "entries"])

        return run

    def blocks(key: np.ndarray, ids: np.ndarray, born: np.ndarray, side: np.ndarray, g: int) -> Iterator[pa.RecordBatch]:
        block = _mixed(ids.view(np.uint64)) % np.uint64(g)
        for k in range(g):
            copies = []
            for mine in (LEFT, RIGHT):
                at = np.flatnonzero(side & mine)
                own, k_ = block[at], np.uint64(k)
                cell = own * np.uint64(1 << 32) + k_ if mine == LEFT else k_ * np.uint64(1 << 32) + own
                copies.append((_mixed(key[at].view(np.uint64) ^ _mixed(cell + np.uint64(1))).view(np.int64), ids[at], born[at], np.full(len(at), mine)))
            part, blobs = _dealt(*(np.concatenate(c) for c in zip(*copies)), parts)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int64)), pa.nulls(len(part), pa.int64()), pa.array(blobs, pa.binary())], ["id", "other", "entries"])

    def meet(most: int | None) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blobs = [x.as_buffer() for b in batches for x in b.column(0)]
            if not blobs:
                return
            key, ids, born, side = _taken(blobs)
            order = np.argsort(key, kind="stable")
            key, ids, born, side = key[order], ids[order], born[order], side[order]
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            group = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(key))))
            left, right = (np.flatnonzero(side & s) for s in (LEFT, RIGHT))
            n_left, n_right = (np.bincount(group[x], minlength=len(new)) for x in (left, right))
            work = n_left * n_right
            if most is not None:
                for hot in np.flatnonzero(work > most):
                    at = slice(new[hot], new[hot + 1] if hot + 1 < len(new) else len(key))
                    yield from blocks(key[at], ids[at], born[at], side[at], int(np.ceil(np.sqrt(work[hot] / most))))
                left = left[work[group[left]] <= most]
            first, count = (np.cumsum(n_right) - n_right)[group[left]], n_right[group[left]]
            ends_ = np.cumsum(count)
            lo = 0
            while lo < len(left):
                hi = max(lo + 1, int(np.searchsorted(ends_, (ends_[lo - 1] if lo else 0) + step, "right")))
                n = count[lo:hi]
                a, b = np.repeat(left[lo:hi], n), right[np.repeat(first[lo:hi] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                lo = hi
                fit = dates_fit(born[a], born[b])
                x, y = ids[a[fit]], ids[b[fit]]
                if within:
                    x, y = np.minimum(x, y)[x != y], np.maximum(x, y)[x != y]
                order = np.lexsort((y, x))
                x, y = x[order], y[order]
                fresh = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(x) else np.empty(0, bool)
                x, y = x[fresh], y[fresh]
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.nulls(len(x), pa.binary())], ["id", "other", "entries"])

        return run

    def met(laid: DataFrame, most: int | None) -> DataFrame:
        return packed(mapped(laid.repartitionById(parts, F.col("part")).select("entries"), meet(most), "id bigint, other bigint, entries binary"))

    found = None
    for kinds in turns:
        laid = reduce(DataFrame.unionByName, [mapped(people, lay(make(kinds)), "part int, entries binary") for people, make in sides])
        some = met(laid, hot_pairs)
        hot = some.where("entries is not null").select(F.col("id").cast("int").alias("part"), "entries")
        pairs = some.where("entries is null") if hot.isEmpty() else some.where("entries is null").unionByName(met(hot, None))
        found = pairs if found is None else found.unionByName(pairs)
        del laid, some, hot, pairs
        release(spark)
    return found.select("id", "other")


def county_level(a, b) -> int:
    if not a or not b:
        return 1
    if a == b:
        return 2
    short, long = sorted((a, b), key=len)
    rest = iter(long)
    return 2 if short[0] == long[0] and len(short) >= 3 and all(c in rest for c in short) else 0


def plain_level(a, b) -> int:
    return 1 if not a or not b else 2 if a == b else 0


def with_namesakes(people: DataFrame) -> DataFrame:
    """``people`` with ``namesakes``: how many of them have the same name parts by sound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("name_key", pa.array(["|".join(sorted({sound(t) for t in ts})) for ts in b.column("toks").to_pylist()], pa.string()))

    keyed = mapped(people, run, StructType([*people.schema, StructField("name_key", StringType())]))
    counts = keyed.groupBy("name_key").agg(F.count("*").alias("namesakes"))
    return keyed.join(counts, "name_key").drop("name_key")


def date_or_none(y, m, d):
    return tuple(None if v is None or v != v else int(v) for v in (y, m, d))
