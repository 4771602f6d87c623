"""Similar sets and nearest vectors against brute force."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from veilink.llm import neighbours, pivots
from veilink.llm import sets as S

SCHEMA = "row_id bigint, bf_indices array<int>, bf_norms double, code string, cells int"  # with clashing extra columns


def clusters(n=120, seed=1, universe=1024):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        base = r.sample(range(universe), 40)
        for k in range(r.choice([1, 1, 2, 3, 7])):
            one = [p for p in base if r.random() > 0.08 * k] + r.sample(range(universe), 2 * k)
            r.shuffle(one)
            rows.append((1000 + len(rows), one + one[:2], None, "c", 1))
    rows += [(1, None, None, "c", 1), (2, [], None, "c", 1), (3, [None], None, "c", 1), (4, [5], None, "c", 1), (5, [5, 5], None, "c", 1), (6, list(range(universe)), None, "c", 1)]
    hot = r.sample(range(universe), 30)
    rows += [(5000 + i, hot, None, "c", 1) for i in range(9)] + [(5100, hot[:-1], None, "c", 1)]
    return rows


def sets_of(rows):
    return {k: {p for p in x if p is not None} for k, x, *_ in rows if x and any(p is not None for p in x)}


def brute_jaccard(sets, t):
    ids = sorted(sets)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9}


def brute_nearest(sets, k, least):
    out = set()
    for a in sets:
        s = sorted((round(len(sets[a] & sets[b]) / math.sqrt(len(sets[a]) * len(sets[b])), 6), b) for b in sets if b != a)[::-1]
        s = [x for x in s if x[0] >= least]
        out |= {(min(a, b), max(a, b)) for v, b in s if v >= s[min(k, len(s)) - 1][0]}
    return out


@pytest.fixture(scope="module")
def table(spark):
    rows = clusters()
    return spark.createDataFrame(rows, SCHEMA), sets_of(rows)


def test_codes_round_trip():
    lists = pa.array([[3, 1, 1, 1023, 256], None, [], [None], list(range(1024))], pa.list_(pa.int32()))
    kept, codes = S.encode(lists, 1024)
    rows, pos, n = S.decode(codes, 1024)
    assert kept.tolist() == [0, 4] and pos[rows == 0].tolist() == [1, 3, 256, 1023] and n.tolist() == [4, 1024]
    rows, pos, _ = S.decode(codes.slice(1, 1), 1024)
    assert pos.tolist() == list(range(1024)) and set(rows) == {0}
    words, sizes = S.bit_words(codes, 1024)
    assert np.bitwise_count(words).sum(1).tolist() == [4, 1024] == sizes.tolist()
    with pytest.raises(ValueError):
        S.encode(pa.array([[1024]], pa.list_(pa.int32())), 1024)


def test_folds_never_differ_more_than_sets():
    r = np.random.default_rng(0)
    w = r.integers(0, 2**63, (50, 16)).astype(np.uint64) & r.integers(0, 2**63, (50, 16)).astype(np.uint64)
    apart = np.bitwise_count(w[:, None] ^ w[None]).sum(2)
    for k in (1, 2, 3, 4):
        f = S.folded(w, k)
        assert (np.bitwise_count(f[:, None] ^ f[None]).sum(2) <= apart).all()


@pytest.mark.parametrize("threshold,block", [(0.7, 8192), (0.7, 5), (0.9, 8192)])
def test_similar_rows(table, threshold, block):
    df, sets = table
    got = [tuple(r) for r in pivots.similar_rows(df, threshold=threshold, block_rows=block, replicas=16).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_jaccard(sets, threshold)


def dense_region(groups=15, seed=7):
    """Sets of one dense region, all of whose sets are within the bound of each other: in each group two sets at 50/70, each with 15 sets that are nearer to it."""
    r = random.Random(seed)
    core, rows = r.sample(range(1024), 36), []
    for _ in range(groups):
        own = r.sample(sorted(set(range(1024)) - set(core)), 34)
        common, sides = own[:14], (own[14:24], own[24:])
        for side in sides:
            for k in range(16):
                one = core + common + side
                if k:
                    one.remove(r.choice(common))
                    one.append(r.choice(sorted(set(range(1024)) - set(core) - set(own))))
                rows.append((len(rows), one, None, "", 0))
    return rows


@pytest.mark.parametrize("block", [32768, 100])
def test_all_pairs_of_a_dense_region(spark, block):
    rows = dense_region()
    want = brute_jaccard(sets_of(rows), 0.7)
    got = [tuple(r) for r in pivots.similar_rows(spark.createDataFrame(rows, SCHEMA), rows_per_cell=1, block_rows=block).collect()]
    assert {(i, i + 16) for i in range(0, len(rows), 32)} <= want and len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.85])
@pytest.mark.parametrize("sets", [0, 10**5, 10**9])  # none, some and all contents count as frequent
def test_segments_lose_no_pair(threshold, sets):
    rows = {k: x for k, x in sets_of(clusters() + [(20_000 + i, list(range(i)), None, "", 0) for i in range(1, 60)]).items()}
    kept, codes = S.encode(pa.array([sorted(rows[k]) for k in sorted(rows)], pa.list_(pa.int32())), 1024)
    segments = S.Segments(S.Rule("jaccard", threshold), [bytes(c.as_py()) for c in codes[:100]], max(map(len, rows.values())), 1024, sets)
    cells = dict(zip(sorted(rows), map(set, segments.cells(codes))))
    assert len(cells) == len(rows) and all(cells[a] & cells[b] for a, b in brute_jaccard(rows, threshold) if rows[a] != rows[b])


def test_copies_of_a_set_dont_grow_with_the_table():
    rows = sets_of(clusters())
    _, codes = S.encode(pa.array([sorted(x) for x in rows.values() if len(x) < 100], pa.list_(pa.int32())), 1024)
    copies = [sum(map(len, S.Segments(S.Rule("jaccard", 0.7), [bytes(c.as_py()) for c in codes[:100]], 97, 1024, sets).cells(codes))) for sets in (10**5, 10**6)]
    assert copies[1] <= 1.1 * copies[0]


@pytest.mark.parametrize("direct", [2, 600])  # with and without second contents
@pytest.mark.parametrize("sets", [10**6, 10**9])
def test_second_contents_lose_no_pair(spark, direct, sets):
    rows = dense_region() + [(1000 + k, *x) for k, *x in clusters(n=60)]
    want = {p for p in brute_jaccard(sets_of(rows), 0.7)}
    rule, distinct = S.Rule("jaccard", 0.7), S.distinct_sets(S.encoded_sets(spark.createDataFrame(rows, SCHEMA), "row_id", "bf_indices", 1024)).persist()
    codes = {r.rep: bytes(r.code) for r in distinct.collect()}
    segments = S.Segments(rule, list(codes.values())[:300], 1024, 1024, sets, cold=1)
    pairs = S.sketch_pairs(S.map_sketches(distinct, segments.prefixes, 1024), rule, direct=direct, rounds=2)
    got = [(r.a, r.b) for r in S.verified(pairs, distinct, rule, 1024).collect()]
    assert len(got) == len(set(got)) and set(got) == {p for p in want if set(p) <= set(codes)}


@pytest.mark.parametrize("most, together", [(512, 32768), (20, 64)])
def test_near_in_runs_lose_no_pair(most, together):
    r = np.random.default_rng(3)
    bits = r.random((900, 128)) < 0.25
    bits[450:] = bits[:450] ^ (r.random((450, 128)) < 0.03)
    folds, sizes, run = np.packbits(bits, axis=1).view(np.uint64), bits.sum(1), r.integers(0, 60, 450).repeat(2).reshape(450, 2).T.ravel() % r.integers(1, 60)
    at = np.lexsort((sizes, run))
    starts, lengths = S.runs_of(run[at])
    rule = S.Rule("jaccard", 0.7)
    apart = np.bitwise_count(folds[:, None, :] ^ folds[None, :, :]).sum(2)
    near = (apart <= rule.most_apart(sizes[:, None].astype(float), sizes[None, :].astype(float)) + 1e-9) & (run[:, None] == run[None, :])
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(near)) if i < j and sizes[[i, j]].min() >= 0.7 * sizes[[i, j]].max()}
    got = [(int(min(i, j)), int(max(i, j))) for x, y in S.near_in_runs(folds, sizes, at, starts, lengths, rule, most, together) for i, j in zip(x, y)]
    assert want and want <= set(got) and len(got) == len(set(got))


def test_exactly_at_the_threshold(spark):
    rows = [(1, list(range(7)), None, "", 0), (2, list(range(10)), None, "", 0), (3, list(range(6)) + [99], None, "", 0)]
    got = {tuple(r) for r in pivots.similar_rows(spark.createDataFrame(rows, SCHEMA), threshold=0.7).collect()}
    assert got == {(1, 2), (1, 3)}  # 7/10 and 6/8


@pytest.mark.parametrize("kind,threshold", [("jaccard", 0.7), ("cosine", 0.6)])
def test_subsets_at_the_boundary_of_two_blocks(kind, threshold):
    rule = S.Rule(kind, threshold)
    for n in range(5, 96):
        small = next(k for k in range(1, n + 1) if rule.holds(np.array([k]), np.array([k]), np.array([n]))[0])
        _, codes = S.encode(pa.array([list(range(n)), list(range(small))], pa.list_(pa.int32())), 1024)
        words, sizes = S.bit_words(codes, 1024)
        for left, right in [([0], [1]), ([1], [0])]:
            assert len(list(S.near_pairs(S.folded(words, 4), sizes, np.array(left), np.array(right), rule, None))) == 1, (n, small)


def test_links(table):
    df, sets = table
    pairs = brute_jaccard(sets, 0.7)
    rows = {r.row_id: r for r in pivots.similar_row_links(df, replicas=16).collect()}
    assert set(rows) == set(sets)
    assert all(rows[k].links == sum(k in p for p in pairs) for k in sets)
    assert rows[5003].class_id == 5000 and rows[5003].copies == 9


def test_bound_names_most_cells(table):
    r = pivots.bound_replication(table[0], pivots=16).first()
    assert 0 < r.share_of_cells <= 1 and r.sets > 0


def test_nearest_rows(table):
    df, sets = table
    want = brute_nearest(sets, 5, 0.6)
    for homes, block in ((1, 32768), (3, 20), (1, 5)):  # with blocks a cell is cut into, and without
        found = [tuple(r) for r in neighbours.nearest_rows(df, homes=homes, probes=16, block_rows=block).collect()]
        got = {r[:2]: r[2] for r in found}
        assert len(found) == len(got) and set(got) == want
    assert all(abs(s - round(len(sets[a] & sets[b]) / math.sqrt(len(sets[a]) * len(sets[b])), 6)) < 1e-9 for (a, b), s in got.items())
    routed = {tuple(r)[:2] for r in neighbours.nearest_rows(df).collect()}
    assert len(routed & want) >= 0.9 * len(want)


def test_dense_sets_that_share_a_part_are_compared_exactly(spark):
    r, rows = random.Random(5), []
    for _ in range(60):
        common = r.sample(range(1024), 240)
        rest = r.sample(sorted(set(range(1024)) - set(common)), 240)
        rows += [(len(rows), common + rest[:120], None, "", 0), (len(rows) + 1, common + rest[120:], None, "", 0)]
    got = {tuple(x)[:2] for x in neighbours.nearest_rows(spark.createDataFrame(rows, SCHEMA), probes=16).collect()}
    assert {(i, i + 1) for i in range(0, 120, 2)} <= got == brute_nearest(sets_of(rows), 5, 0.6)


def test_ties_all_count(spark):
    base = list(range(20))
    rows = [(0, base, None, "", 0)] + [(i, base[:-1] + [100 + i], None, "", 0) for i in range(1, 9)]
    got = {tuple(r)[:2] for r in neighbours.nearest_rows(spark.createDataFrame(rows, SCHEMA), probes=16).collect()}
    assert {(0, i) for i in range(1, 9)} <= got


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert neighbours.nearest_rows(none).count() == 0 and pivots.similar_rows(none).count() == 0 and pivots.similar_row_links(none).count() == 0
    only = spark.createDataFrame([(1, None, None, "", 0), (2, [], None, "", 0)], SCHEMA)
    assert neighbours.nearest_rows(only).count() == 0 and pivots.similar_rows(only).count() == 0


def test_balanced_parts_and_router():
    r = np.random.default_rng(1)
    group = np.repeat(np.arange(8), 40)
    near = np.stack([r.choice(np.flatnonzero(group == g), 6) for g in group])
    label = neighbours.balanced_parts(near, 8)
    sizes = np.bincount(label, minlength=8)
    assert sizes.max() <= 45 and sizes.min() >= 20
    together = np.mean([label[i] == label[j] for i in range(len(near)) for j in near[i]])
    assert together > 0.8


def test_parts_follow_the_table_beyond_their_bound(spark):
    """16 parts of n rows hold n/16 rows somewhere; cut into pieces, none does, and neighbours still meet."""
    sets = sets_of(clusters(n=500))
    distinct = S.distinct_sets(S.encoded_sets(spark.createDataFrame(clusters(n=500), SCHEMA), "row_id", "bf_indices", 1024)).persist()
    codes = {r.rep: bytes(r.code) for r in distinct.collect()}
    router = neighbours.fit_router(distinct, len(codes), universe=1024, rows_per_part=8, most_parts=16)
    cells = dict(zip(codes, router.route(pa.array(codes.values(), pa.binary()), 1024, 7)))
    assert max(np.bincount([c[0] for c in cells.values()])) < len(codes) / 16
    pairs = [p for p in brute_nearest({k: sets[k] for k in codes}, 5, 0.6)]
    met = sum(bool({*cells[a][:2]} & {*cells[b]} or {*cells[b][:2]} & {*cells[a]}) for a, b in pairs)
    assert met >= 0.9 * len(pairs) and all(len(set(c)) == 7 for c in cells.values())


def test_norms(spark):
    rows = [(1, [1, 2, 2, 4], None), (2, [1], float("nan")), (3, [1, 2, 3, 4], 2.0), (4, [1, 2, 3, 4], 5.0), (5, None, 1.0), (6, [], None)]
    got = {r.row_id: (round(r.bf_norms, 6), r.norm_repaired) for r in neighbours.repaired_norms(spark.createDataFrame(rows, "row_id bigint, bf_indices array<int>, bf_norms double")).collect()}
    assert got == {1: (1.732051, True), 2: (1.0, True), 3: (2.0, False), 4: (2.0, True), 5: (0.0, True), 6: (0.0, True)}


@pytest.mark.parametrize("share, words, fits", [(0.05, 4, True), (0.05, 2, True), (0.2, 4, True), (0.6, 4, False)])
def test_folds_compared_by_products_lose_nothing(share, words, fits):
    r = np.random.default_rng(5)
    bits = r.random((1700, 64 * words)) < share * r.uniform(0.5, 1.5, (1700, 1))
    bits[850:] = bits[:850] ^ (r.random((850, 64 * words)) < 0.02)
    bits[:, 0] = True
    folds, sizes = np.packbits(bits, axis=1).view(np.uint64), bits.sum(1)
    left, right = np.arange(0, 900), np.arange(900, 1700)
    assert bool(S._by_products(folds, left, right, 768, 512)) == fits
    apart = np.bitwise_count(folds[:, None, :] ^ folds[None, :, :]).sum(2)
    for rule in (S.Rule("cosine", 0.6), S.Rule("jaccard", 0.7)):
        near = apart <= rule.most_apart(sizes[:, None].astype(float), sizes[None, :].astype(float)) + 1e-9
        for second in (right, None):
            got = {(int(min(i, j)), int(max(i, j))) for x, y in S.near_pairs(folds, sizes, left, second, rule, None) for i, j in zip(x, y)}
            want = {(int(i), int(j)) for i, j in zip(*np.nonzero(near)) if i < j and i < 900 and ((j >= 900) if second is not None else (j < 900))}
            assert want and want <= got
