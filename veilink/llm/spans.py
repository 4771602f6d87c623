"""Exact spans shared between records: maximal stretches covered by runs of at least ``min_chars`` that stand in another record.

Every window of ``min_chars`` characters is a suffix cut at that depth. Windows are split into groups by a content-defined
prefix: the ``seed_chars`` characters that hash lowest in the window (its anchor), lengthened to the right, or where the
window has less room there to the left, to over half of ``min_chars``. Equal windows have equal prefixes, so
each group is a complete subtree of the text's suffix tree below that prefix, and consecutive windows of a text that share a
prefix travel as one *piece*. A group whose anchor stands in one record only is dropped; a piece whose content stands in
two records is shared as a whole (an internal node deep enough for all its windows); only where a run ends must single windows be compared, and
only for such pieces is text read again. A group's pieces meet in one task as long as they are few; the windows of a hot group are
split further by their content.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed, shuffle_width, spread

PIECES = "doc bigint, key bigint, piece bigint, lo int, n int"
JUDGED = "doc bigint, key bigint, lo int, n int"
RUNS = "doc bigint, lo int, hi int"
CLASSES = 1 << 17  # of keys, for the first count
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The powers 0..n of an odd number modulo 2**64; the longest array so far is kept."""
    if len(_POWERS.get(base, ())) <= n:
        p = np.full(max(n, 1 << 16) + 1, np.uint64(base), np.uint64)
        p[0] = 1
        _POWERS[base] = np.multiply.accumulate(p)
    return _POWERS[base]


class Hashes:
    """Polynomial hashes modulo 2**64 of any stretch of a code-point array, by prefix sums over mixed characters."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.inv = powers(pow(int(_ODD), -1, 1 << 64), n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed(codes.astype(np.uint64) + _ODD) * powers(int(_ODD), n)[:n], out=self.sums[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hash of characters lo..hi-1; equal stretches of any texts have equal hashes."""
        return mixed((self.sums[hi] - self.sums[lo]) * self.inv[lo])


def sliding_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """Position of the (leftmost) minimum of every window of ``w`` values, by two passes of running minima over blocks."""
    n = len(h)
    pad = -n % w
    v = np.concatenate([h, np.full(pad, np.uint64(2**64 - 1))]).reshape(-1, w)
    left = np.minimum.accumulate(v, axis=1).ravel()[:n]
    right = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    low = np.minimum(right[: n - w + 1], left[w - 1 :])
    # the leftmost place of the minimum never moves back from one window to the next
    change = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    places = np.empty(len(low), np.int64)
    ends = np.append(change[1:], len(low))
    for s, e in zip(change.tolist(), ends.tolist()):
        value, at = low[s], s
        while at < e:
            p = at + int(np.argmax(h[at : at + w] == value))
            stop = min(e, p + 1)
            places[at:stop] = p
            at = stop
    return places


def pieces_of(text: str, min_chars: int, seed_chars: int) -> tuple[np.ndarray, ...] | None:
    """(key, piece hash, first window, number of windows) of a text's pieces."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) < min_chars:
        return None
    hashes = Hashes(codes)
    at = np.arange(len(codes) - seed_chars + 1)
    seeds = hashes.of(at, at + seed_chars)
    anchors = sliding_argmin(seeds, min_chars - seed_chars + 1)
    room = min_chars - seed_chars
    offset = anchors - np.arange(len(anchors))
    right = offset <= room // 2  # the window reaches further to the right of its anchor than to the left
    lo = np.flatnonzero(np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (right[1:] != right[:-1])]))
    hi = np.append(lo[1:], len(anchors))
    spot, to_right = anchors[lo], right[lo]
    first = np.where(to_right, spot, spot - room // 2 - 1)
    last = np.where(to_right, spot + min_chars - room // 2, spot + seed_chars)
    key = mixed(hashes.of(first, last) ^ np.where(to_right, np.uint64(1), np.uint64(2)))
    return key, mixed(hashes.of(lo, hi - 1 + min_chars) ^ (hi - lo).astype(np.uint64) ^ mixed((spot - lo).astype(np.uint64))), lo, hi - lo


def _cut(min_chars: int, seed_chars: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for doc, text in zip(batch.iloc[:, 0], batch.iloc[:, 1]):
                if (p := pieces_of(text, min_chars, seed_chars)) is not None:
                    key, piece, lo, n = p
                    found.append(pd.DataFrame({"doc": np.int64(doc), "key": key.view(np.int64), "piece": piece.view(np.int64), "lo": lo.astype(np.int32), "n": n.astype(np.int32)}))
            if found:
                yield pd.concat(found, ignore_index=True)

    return run


def _texts(min_chars: int):
    """The wanted pieces' characters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [
                (doc, w["key"], w["lo"], w["hot"], text[w["lo"] : w["lo"] + w["n"] - 1 + min_chars])
                for doc, text, wanted in zip(batch["doc"], batch["text"], batch["wanted"]) for w in wanted
            ]
            yield pd.DataFrame(found, columns=["doc", "key", "lo", "hot", "chars"])

    return run


def window_hashes(batch: pd.DataFrame, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start in the record, hash) of all windows of pieces; only windows of one group can have equal hashes."""
    rows, starts, hashes = [], [], []
    for i, (key, lo, chars) in enumerate(zip(batch["key"], batch["lo"], batch["chars"])):
        h = Hashes(np.frombuffer(chars.encode("utf-32-le", "surrogatepass"), np.uint32))
        at = np.arange(len(h.sums) - min_chars)
        rows.append(np.full(len(at), i))
        starts.append(at + lo)
        hashes.append(h.of(at, at + min_chars) ^ mixed(np.array([key], np.int64).view(np.uint64)))
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(rows), np.concatenate(starts), np.concatenate(hashes)


def _explode(min_chars: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, starts, hashes = window_hashes(batch, min_chars)
            yield pd.DataFrame({"doc": batch["doc"].to_numpy()[rows], "window": hashes.view(np.int64), "at": starts.astype(np.int32)})

    return run


def _meet(min_chars: int):
    """Runs of windows that stand in two records, of all groups of a partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        batch = pd.concat(held, ignore_index=True).sort_values(["doc", "key", "lo"], ignore_index=True)
        rows, starts, hashes = window_hashes(batch, min_chars)
        docs = batch["doc"].to_numpy()[rows]
        order = np.lexsort((docs, hashes))
        edge = np.flatnonzero(np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]]))
        sizes = np.diff(np.append(edge, len(order)))
        shared = np.empty(len(order), bool)
        shared[order] = np.repeat(docs[order[edge]] != docs[order[edge + sizes - 1]], sizes)
        rows, starts, docs = rows[shared], starts[shared], docs[shared]
        if len(rows):
            first = np.concatenate([[True], (rows[1:] != rows[:-1]) | (starts[1:] != starts[:-1] + 1)])
            last = np.append(first[1:], True)
            yield pd.DataFrame({"doc": docs[first], "lo": starts[first].astype(np.int32), "hi": (starts[last] + min_chars).astype(np.int32)})

    return run


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of whole groups: pieces that stand in two records (key null), and the pieces of a group in which runs end."""
    held = [b for b in batches if len(b)]
    if not held:
        return
    doc, key, piece, lo, n = (np.concatenate([b[c].to_numpy() for b in held]) for c in ("doc", "key", "piece", "lo", "n"))
    order = np.lexsort((doc, piece, key))
    doc, key, piece, lo, n = doc[order], key[order], piece[order], lo[order], n[order]
    new_key = np.concatenate([[True], key[1:] != key[:-1]])
    first = np.flatnonzero(new_key | np.concatenate([[True], piece[1:] != piece[:-1]]))
    sizes = np.diff(np.append(first, len(doc)))
    d0, d1 = doc[first], doc[first + sizes - 1]
    of_key = np.cumsum(new_key)[first] - 1
    starts = np.flatnonzero(new_key[first])
    live = np.minimum.reduceat(d0, starts) != np.maximum.reduceat(d1, starts)
    ends = live & np.logical_or.reduceat(d0 == d1, starts)
    is_whole = np.repeat(d0 != d1, sizes)
    # all places of a piece that stands in one record, and of the others one place in each of two records to compare with
    single, both = np.repeat(ends[of_key] & (d0 == d1), sizes), ends[of_key] & (d0 != d1)
    at = np.concatenate([np.flatnonzero(single), first[both], (first + sizes - 1)[both]])
    yield pd.DataFrame({"doc": doc[is_whole], "key": pd.array([None] * int(is_whole.sum()), "Int64"), "lo": lo[is_whole], "n": n[is_whole]})
    yield pd.DataFrame({"doc": doc[at], "key": pd.array(key[at], "Int64"), "lo": lo[at], "n": n[at]})


def _judge_hot(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same for groups of any size, with aggregates that combine before they shuffle."""
    distinct = pieces.groupBy("key", "piece").agg(F.min("doc").alias("d0"), F.max("doc").alias("d1"), F.min(F.struct("doc", "lo", "n")).alias("place"), F.max(F.struct("doc", "lo", "n")).alias("last"))
    distinct = checkpointed(distinct)
    groups = distinct.groupBy("key").agg(F.min("d0").alias("k0"), F.max("d1").alias("k1"), F.max(F.col("d0") == F.col("d1")).alias("ends")).where("k0 <> k1").select("key", "ends")
    status = distinct.join(groups, "key")
    whole = pieces.join(status.where("d0 <> d1").select("key", "piece"), ["key", "piece"], "left_semi").select("doc", F.lit(None).cast("bigint").alias("key"), "lo", "n")
    single = pieces.join(status.where("ends and d0 = d1").select("key", "piece"), ["key", "piece"], "left_semi").select("doc", "key", "lo", "n", F.lit(True).alias("hot"))
    for place in ("place", "last"):
        single = single.unionByName(status.where("ends and d0 <> d1").select(f"{place}.doc", "key", f"{place}.lo", f"{place}.n", F.lit(True).alias("hot")))
    return whole, single


def hot_keys(pieces: DataFrame, most: int) -> DataFrame:
    """Keys (``key``) of over ``most`` pieces. Classes of keys are counted in each partition first; only keys of large classes are counted one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CLASSES, np.int64)
        for b in batches:
            counts += np.bincount(b.column(0).to_numpy() & (CLASSES - 1), minlength=CLASSES)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["class", "n"])

    warm = checkpointed(pieces.select("key").mapInArrow(run, "class bigint, n bigint").groupBy("class").agg(F.sum("n").alias("n")).where(F.col("n") > most).select("class"))  # at most CLASSES rows
    if warm.isEmpty():
        return pieces.select("key").limit(0)
    some = pieces.select("key", F.col("key").bitwiseAND(CLASSES - 1).alias("class")).join(F.broadcast(warm), "class", "left_semi")
    return checkpointed(some.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most).select("key"))


def shared_spans(
    documents: DataFrame, *, key: str = "doc_id", text: str = "text", min_chars: int = 200, seed_chars: int = 32, broadcast_rows: int = 1_000_000,
    group_pieces: int = 100_000, task_chars: int = 4_000_000,
) -> DataFrame:
    """(``key``, ``start_char``, ``end_char``) of every maximal shared stretch.

    Null, empty and short texts have none. Two rows of one key are one record: what only they share isn't a case, and their
    stretches are merged. Extra columns are ignored, empty tables give no rows. Runs repeated only inside a record don't count.
    A group of over ``group_pieces`` pieces never meets in one task, and a task reads about ``task_chars`` characters of pieces at most.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text")).where(F.length(text) >= min_chars)
    pieces = spread(docs).mapInPandas(_cut(min_chars, seed_chars), PIECES).persist()
    n = pieces.count()
    frequent = hot_keys(pieces, group_pieces)
    n_hot = frequent.count()
    listed = F.broadcast(frequent) if n_hot <= broadcast_rows else frequent  # 8 bytes a key
    parts = max(shuffle_width(spark), -(-n // 250_000))
    usual = pieces.join(listed, "key", "left_anti") if n_hot else pieces
    judged = usual.repartition(parts, "key").mapInPandas(_judge, JUDGED).persist()
    whole, wanted = judged.where("key is null"), judged.where("key is not null").withColumn("hot", F.lit(False))
    if n_hot:
        hot_whole, hot_wanted = _judge_hot(pieces.join(listed, "key", "left_semi"))
        whole, wanted = whole.unionByName(hot_whole), wanted.unionByName(hot_wanted)
    whole = whole.select("doc", "lo", (F.col("lo") + F.col("n") - 1 + min_chars).alias("hi"))
    wanted = wanted.groupBy("doc").agg(F.collect_list(F.struct("key", "lo", "n", "hot")).alias("wanted")).persist()
    chars = F.aggregate("wanted", F.lit(0).cast("bigint"), lambda s, w: s + w["n"] + min_chars)
    n_wanted, n_chars = wanted.agg(F.coalesce(F.sum(F.size("wanted")), F.lit(0)), F.coalesce(F.sum(chars), F.lit(0))).first()
    texts = docs.join(F.broadcast(wanted) if n_wanted <= broadcast_rows else wanted, "doc").select("doc", "text", "wanted").mapInPandas(_texts(min_chars), "doc bigint, key bigint, lo int, hot boolean, chars string").persist()
    meeting = texts.where("not hot").repartition(max(shuffle_width(spark), -(-n_chars // task_chars)), "key").mapInPandas(_meet(min_chars), RUNS)
    runs = whole.unionByName(meeting)
    if n_hot:
        windows = texts.where("hot").mapInPandas(_explode(min_chars), "doc bigint, window bigint, at int")
        twice = windows.groupBy("window").agg(F.min("doc").alias("d0"), F.max("doc").alias("d1")).where("d0 <> d1").select("window")
        runs = runs.unionByName(windows.join(twice, "window", "left_semi").select("doc", F.col("at").alias("lo"), (F.col("at") + min_chars).alias("hi")))
    return merged_runs(runs, key)


def merged_runs(runs: DataFrame, key: str) -> DataFrame:
    """Union of overlapping or touching stretches of each record: islands of a running maximum of their ends."""
    earlier = Window.partitionBy("doc").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy("doc").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, 0)
    begins = runs.withColumn("begins", F.when(F.max("hi").over(earlier) >= F.col("lo"), 0).otherwise(1))
    return (
        begins.withColumn("island", F.sum("begins").over(so_far))
        .groupBy("doc", "island").agg(F.min("lo").alias("start_char"), F.max("hi").alias("end_char"))
        .select(F.col("doc").alias(key), "start_char", "end_char")
    )


def shared_fraction(documents: DataFrame, spans: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each record: ``n_chars``, ``shared_chars`` and their quotient (0 for null and empty texts)."""
    sizes = documents.groupBy(key).agg(F.max(F.coalesce(F.length(text), F.lit(0))).alias("n_chars"))
    got = spans.groupBy(key).agg(F.sum(F.col("end_char") - F.col("start_char")).alias("shared_chars"), F.count("*").alias("spans"))
    return sizes.join(got, key, "left").na.fill(0, ["shared_chars", "spans"]).withColumn("shared_fraction", F.round(F.col("shared_chars") / F.greatest("n_chars", F.lit(1)), 6))
