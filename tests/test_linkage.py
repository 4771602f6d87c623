"""Embedding, comparison, matching, private index, training, exchange."""

import itertools
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilink.functions.bloom import BloomFilter
from veilink.operators.assign import assign, assign_sparse
from veilink.operators.crypto import LocalKeyProvider, RsaKeyProvider, decrypt_table, encrypt_table, new_key
from veilink.operators.embed import Embedded, Embedder, party_to_filters
from veilink.operators.link import components, match, perform_matching, performance, private_index
from veilink.operators.similarity import compare, compare_indexed
from veilink.operators.train import joint_frequencies, nearest_positive, train
from veilink.sources import config, tables

A = [(0, "Laura", "Daten", "f", "bass"), (1, "Kaspar", "Gorman", "m", "guitar"), (2, "Grete", "Knopf", "f", "drums")]
B = [(0, "Laura Datten", "female", "bass guitar"), (1, "Greta Knopf", "female", "percussion"), (2, "Casper Goreman", "male", "electric guitar")]


@pytest.fixture(scope="module")
def toy(spark):
    a = spark.createDataFrame(A, "id int, first_name string, last_name string, gender string, instrument string")
    b = spark.createDataFrame(B, "id int, name string, sex string, main_instrument string")
    e = Embedder(options={"shingled": {"label": "instrument"}})
    spec_a = {"first_name": "name", "last_name": "name", "gender": "sex", "instrument": "shingled"}
    spec_b = {"name": "name", "sex": "sex", "main_instrument": "shingled"}
    made = [e.embed(d, s, "id", update_thresholds=True) for d, s in ((a, spec_a), (b, spec_b))]
    return e, *(Embedded(m.df.persist(), m.checksum, "id") for m in made)


def test_golden_matrix_and_match(toy):
    e, x, y = toy
    pairs = compare(e, x, y).persist()
    got = {(r.id1, r.id2): r.sim for r in pairs.collect()}
    want = [[0.81229552, 0.1115206, 0.09557733], [0.35460909, 0.16368072, 0.60428527], [0.11720977, 0.50957391, 0.10343462]]
    assert all(abs(got[i, j] - want[i][j]) < 1e-6 for i in range(3) for j in range(3))
    assert {(r.id1, r.id2) for r in match(pairs, mode="many").collect()} >= {(0, 0), (1, 2), (2, 1)}
    for mode in ("exact", "sparse"):
        assert sorted((r.id1, r.id2) for r in match(pairs, mode=mode).collect()) == [(0, 0), (1, 2), (2, 1)]
    indexed = {(r.id1, r.id2): r.sim for r in compare_indexed(x, y).collect()}
    assert all(abs(indexed[k] - v) < 1e-12 for k, v in got.items())


def test_blocks_agree(toy):
    e, x, y = toy
    small = {(r.id1, r.id2): r.sim for r in compare(e, x, y, block_rows=1).collect()}
    assert small == {(r.id1, r.id2): r.sim for r in compare(e, x, y).collect()}


def test_names_example(spark):
    e = Embedder(BloomFilter(num_hashes=1), {"name": {"ngram_length": [2]}})
    sides = []
    for names in (["Bob", "Sally", "Samina", "John"], ["Saly", "Rob", "Jon", "Ade"]):
        df = spark.createDataFrame(list(enumerate(names)), "id int, name string")
        sides.append(e.embed(df, {"name": "name"}, "id", update_thresholds=True))
    got = match(compare(e, *sides), abs_cutoff=0.2, mode="exact").collect()
    assert sorted((r.id1, r.id2) for r in got) == [(0, 1), (1, 0), (3, 2)]


def test_embed_edges(spark):
    e = Embedder()
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "ann", "z"), (3, "ann", "z")], "id int, name string, bf_indices string")
    made = e.embed(df, {"name": "name"}, "id", update_thresholds=True).df
    rows = {r.id: r for r in made.collect()}
    assert made.count() == 4 and rows[1].bf_indices == [] and rows[1].bf_norms == 0 and rows[1].thresholds == 0 and rows[3].thresholds == 0
    lone = e.embed(df.where("id = 3").limit(1), {"name": "name"}, "id", update_thresholds=True).df.first()
    assert lone.thresholds == float("-inf")
    assert e.embed(df.where("id = 9"), {"name": "name"}, "id", update_thresholds=True).df.count() == 0
    with pytest.raises(ValueError):
        e.embed(df, {"absent": "name"}, "id")
    with pytest.raises(ValueError):
        e.embed(df, {"name": "unknown"}, "id")
    with pytest.raises(ValueError):
        Embedded.from_df(df.drop("bf_indices"), e, "id")


def test_anonymise_order(spark):
    df = spark.createDataFrame([(1, "bob", 18, "jones", [23, 31])], "idx int, firstname string, age int, lastname string, bf_indices array<int>")
    e = Embedder()
    assert Embedded.from_df(df, e, "idx", update_norms=False).anonymise(["lastname", "age", "idx", "idx"]).columns == ["idx", "age", "lastname", "bf_indices"]


def test_flagship_columns(spark):
    df = spark.createDataFrame([(1, "Hugo", "1/2/2000", "x"), (2, "Ada", None, "y")], "id int, name string, born string, other string")
    out = party_to_filters(df, {"name": "name", "born": "dob"}, "id", ["id", "other"], salt="s")
    assert set(out.columns) == {"id", "other", "bf_indices", "bf_norms", "thresholds"} and out.count() == 2


@pytest.mark.parametrize("seed", range(40))
def test_assignment_against_permutations(seed):
    r = np.random.default_rng(seed)
    n, m = map(int, r.integers(1, 6, 2))
    s = np.round(r.normal(size=(n, m)), seed % 3)
    rows, cols = assign(s)
    wide = s if n <= m else s.T
    best = max(sum(wide[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(wide.shape[1]), wide.shape[0]))
    assert abs(s[rows, cols].sum() - best) < 1e-9 and len(set(rows)) == len(set(cols)) == min(n, m)


def test_assignment_edges():
    assert [len(x) for x in assign(np.zeros((0, 3)))] == [0, 0]
    with pytest.raises(ValueError):
        assign(np.array([[np.nan]]))


def test_exact_lets_failing_pairs_take_records(spark):
    rows = [(1, 1, 0.9, 0.0, 0.0), (1, 2, 0.8, 0.0, 0.0), (2, 1, 0.85, 0.0, 0.0), (2, 2, 0.1, 0.0, 0.0)]
    pairs = spark.createDataFrame(rows, "id1 int, id2 int, sim double, th1 double, th2 double")
    assert sorted((r.id1, r.id2) for r in match(pairs, abs_cutoff=0.82, mode="exact").collect()) == [(2, 1)]
    assert sorted((r.id1, r.id2) for r in match(pairs, abs_cutoff=0.82, mode="sparse").collect()) == [(1, 1)]
    assert match(pairs, abs_cutoff=0.9, mode="many").count() == 1  # equality passes


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(25)] + [(100 + i, 101 + i) for i in range(4)] + [(7, 7), (7, 7)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges + [(None, 3)], "a int, b int")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_private_index(spark):
    x = spark.createDataFrame([(i, c) for i, c in enumerate("abcd")], "i int, x string")
    y = spark.createDataFrame([(i, c) for i, c in enumerate("abcd")], "j int, y string")
    m = spark.createDataFrame([(0, 0), (2, 2)], "id1 int, id2 int")
    a, b = private_index(x, y, m, "i", "j", 10)
    assert sorted(r.x + r.y for r in a.join(b, "private_index").collect()) == ["aa", "cc"]
    numbers = [r.private_index for r in a.collect()] + [r.private_index for r in b.collect()]
    assert len(set(numbers)) == 6 and all(10 <= n < 30 for n in numbers)
    with pytest.raises(ValueError):
        private_index(x, y, m, "i", "j", 2)
    with pytest.raises(ValueError):
        private_index(x, y, spark.createDataFrame([(0, 0), (0, 1)], "id1 int, id2 int"), "i", "j")
    with pytest.raises(ValueError):
        private_index(x.withColumn("private_index", F.lit(1)), y, m, "i", "j")


def test_performance(spark):
    d1 = spark.createDataFrame([(1, 7), (2, 8), (3, 9)], "a int, true_id int")
    d2 = spark.createDataFrame([(1, 7), (2, 9), (3, 8)], "b int, true_id int")
    r = performance(spark.createDataFrame([(1, 1), (2, 2)], "id1 int, id2 int"), d1, d2, "a", "b").first()
    assert (r.matches, r.true_positives, r.false_positives, r.possible, r.precision) == (2, 1, 1, 3, 0.5)
    assert performance(spark.createDataFrame([], "id1 int, id2 int"), d1, d2, "a", "b").first().precision is None


def test_perform_matching(spark, toy):
    e, x, y = toy
    a, b, m = perform_matching(x.anonymise(["id"]), y.anonymise(["id"]), e, "id", "id", 10)
    assert m.count() == 3 and a.join(b, "private_index").count() == 3
    with pytest.raises(ValueError):
        compare(Embedder(BloomFilter(512)), x, y)


def test_joint_frequencies(spark):
    pairs = spark.createDataFrame([([0, 1], [1]), ([2], [2, 2]), (None, [1]), ([], [])], "x array<int>, y array<int>")
    got = {(r.i, r.j): r["count"] for r in joint_frequencies(pairs).collect()}
    assert got == {(0, 1): 0.5, (1, 0): 0.5, (1, 1): 1.0, (2, 2): 1.0}
    assert joint_frequencies(pairs, prob=True).where("i = 2").first()["count"] == 0.25


def test_training_and_storage(spark, tmp_path, toy):
    e, x, _ = toy
    t = train(e, x, x, ("id", "id"), seed=1)
    assert t.checksum != e.checksum and np.linalg.eigvalsh(t.scm.astype(float)).min() > -1e-3
    t.save(str(tmp_path / "e"))
    assert Embedder.load(str(tmp_path / "e")).checksum == t.checksum == Embedder.load(data=t.to_bytes()).checksum
    with pytest.raises(ValueError):
        Embedder.load()
    np.save(tmp_path / "e" / "scm.npy", np.eye(1024, dtype=np.float32))
    with pytest.raises(ValueError):
        Embedder.load(str(tmp_path / "e"))
    fresh = Embedded.from_df(x.df, t, "id", update_thresholds=True)
    self_sim = compare(t, fresh, fresh).where("id1 = id2").collect()
    assert all(abs(r.sim - 1) < 1e-3 for r in self_sim)


def test_nearest_positive():
    r = np.random.default_rng(0).normal(size=(8, 8))
    fixed = nearest_positive(r)
    assert np.allclose(fixed, fixed.T) and np.linalg.eigvalsh(fixed).min() > -1e-9
    good = r @ r.T
    assert np.allclose(nearest_positive(good), good)


def test_encryption(spark):
    df = spark.createDataFrame([(1, True, "a"), (None, False, None), (3, None, "ü\n")], "ints int, bools boolean, strings string")
    hidden, key = encrypt_table(df)
    assert sorted(map(str, decrypt_table(hidden, key, "ints int, bools boolean, strings string").collect())) == sorted(map(str, df.collect()))
    assert decrypt_table(encrypt_table(df.limit(0), key)[0], key, "ints int").count() == 0
    with pytest.raises(Exception):
        decrypt_table(hidden, new_key(), "ints int").collect()
    for p in (LocalKeyProvider(spark), RsaKeyProvider(spark)):
        one, two = p.wrap(key), p.wrap(key)
        assert p.unwrap(one) == key == p.unwrap(two) and one != two
    rsa = RsaKeyProvider(spark)
    public = RsaKeyProvider(spark, public=rsa.public)
    assert rsa.unwrap(public.wrap(key)) == key
    with pytest.raises(ValueError):
        public.unwrap(public.wrap(key))


def test_no_key_in_a_plan(spark):
    df = spark.range(3)
    hidden, key = encrypt_table(df)
    for d in (hidden, decrypt_table(hidden, key, "id bigint")):
        plan = d._jdf.queryExecution().toString()
        assert key.hex().upper() not in plan.upper()


def test_encrypted_link_job(spark, tmp_path, toy):
    from veilink.plans.link_job import main

    e, x, y = toy
    provider, folder = RsaKeyProvider(spark), str(tmp_path)
    keys = {}
    for name, edf in (("one", x), ("two", y)):
        keys[name] = new_key()
        tables.write_encrypted(edf.anonymise(["id"]), folder, name, keys[name], provider, "data")
    (tmp_path / "job.pem").write_text(provider.private)
    (tmp_path / ".env").write_text(f"PARTY_1=one\nPARTY_2=two\nDATA_DIR={folder}\nPRODUCTION=1\nPRIVATE_KEY_FILE={tmp_path}/job.pem\n")
    e.save(f"file://{folder}/embedder")
    main(["--env", str(tmp_path / ".env"), "--embedder", f"file://{folder}/embedder", "--size", "10", "--schema", "id int, bf_indices array<int>, bf_norms double, thresholds double"])
    out = {}
    for name in keys:
        payload = spark.read.schema("payload string").json(f"{folder}/{name}-output.json").select(F.unbase64("payload").alias("payload"))
        out[name] = decrypt_table(payload, keys[name], "id int, private_index bigint")
    assert sorted((r.a, r.b) for r in out["one"].select(F.col("id").alias("a"), "private_index").join(out["two"].select(F.col("id").alias("b"), "private_index"), "private_index").collect()) == [(0, 0), (1, 2), (2, 1)]


def test_sources(spark, tmp_path, toy):
    assert [tables.is_csv(p) for p in ("a.csv", "b.CSV", ".csv", "csv", "a.csv.txt", "", "d/x.csv")] == [True, True, False, False, False, False, True]
    (tmp_path / "p.csv").write_text('id,name\n1,"a ""b"""\n2,\n')
    assert [(r.id, r.name) for r in tables.read_party(spark, str(tmp_path / "p.csv")).collect()] == [("1", 'a "b"'), ("2", "")]
    e, x, _ = toy
    for kind in ("json", "parquet"):
        tables.write_party(x.anonymise(["id"]), str(tmp_path / f"out.{kind}"), kind)
        back = tables.read_embedded(spark, str(tmp_path / f"out.{kind}"), e, "id")
        assert {r.id: r.bf_indices for r in back.df.collect()} == {r.id: r.bf_indices for r in x.df.collect()}
    tables.export_bundle(x, e, str(tmp_path / "bundle"), archive=str(tmp_path / "bundle.zip"))
    shared = spark.read.csv(str(tmp_path / "bundle/data"), header=True)
    assert shared.columns == ["id", "bf_indices", "bf_norms", "thresholds"] and shared.count() == 3
    with zipfile.ZipFile(tmp_path / "bundle.zip") as z:
        assert set(z.namelist()) == {"data.csv", "embedder/embedder.json"} and z.read("data.csv").decode().splitlines()[0] == "id,bf_indices,bf_norms,thresholds"
    a, b = tables.sample_parties(spark, 50)
    assert a.columns == b.columns and a.count() == 50 and a.join(b, a.columns).count() < 50 and a.join(b, "true_id").count() == 50
    assert tables.load_shared_embedder([str(tmp_path / "bundle/embedder")] * 2).checksum == e.checksum
    Embedder(BloomFilter(512)).save(str(tmp_path / "other"))
    with pytest.raises(ValueError):
        tables.load_shared_embedder([str(tmp_path / "bundle/embedder"), str(tmp_path / "other")])
    assert tables.assign_columns({"a": "drop", "b": "keep", "c": "name", "salt": "x"}, {"name": len}) == (["a"], ["b"], {"c": len})
    assert tables.party_paths("/d", "p")[0] == "/d/p-data.json"


def test_settings(tmp_path):
    (tmp_path / ".env").write_text('# c\nPARTY_1=one\nexport PARTY_2="two x" # c\n\nbad line\n')
    assert config.read_env(str(tmp_path / ".env")) == {"PARTY_1": "one", "PARTY_2": "two x"}
    got = config.linkage_settings(config.settings(str(tmp_path / ".env"), {"PRODUCTION": "1"}))
    assert got["parties"] == ("one", "two x") and got["production"]
    with pytest.raises(ValueError):
        config.linkage_settings({})
    assert config.read_env(str(tmp_path / "absent")) == {}


def test_stream(spark, tmp_path, toy):
    from veilink.streaming.embed_stream import embed_stream, stream_static_matches, write_stream

    e, x, _ = toy
    spark.createDataFrame([(5, "Laura", "Daten")], "id int, first_name string, last_name string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, first_name string, last_name string").parquet(str(tmp_path / "in"))
    out = embed_stream(stream, e, {"first_name": "name", "last_name": "name"}, "id")
    write_stream(out, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    done = spark.read.parquet(str(tmp_path / "out"))
    assert done.count() == 1
    best = stream_static_matches(done.select("id", "bf_indices"), x, 0.5).collect()
    assert [(r.id1, r.id2) for r in best] == [(5, 0)]


def test_sparse_assignment_is_as_good_as_the_dense_one():
    r = np.random.default_rng(0)
    for _ in range(200):
        n, m = r.integers(1, 9, 2)
        w = np.where(r.random((n, m)) < r.random(), np.round(r.random((n, m)), r.integers(1, 4)), 0)
        i, j = np.nonzero(w)
        k = assign_sparse(i, j, w[i, j], n, m)
        assert len(set(i[k])) == len(k) == len(set(j[k])) and abs(w[i[k], j[k]].sum() - w[assign(w)].sum()) < 1e-9


def test_filters_of_any_size_on_a_file(spark, tmp_path):
    import hashlib

    spark.createDataFrame([(1, ["a", "bc", "ü"]), (2, None), (3, [])], "id int, f array<string>").write.parquet(str(tmp_path / "f"))
    df = spark.read.parquet(str(tmp_path / "f"))
    for size, offset in ((1000, 7), (1024, 0), (999_983, 3), (3, 0), (1 << 20, 1)):
        b = BloomFilter(size, 2, offset, "s")
        want = sorted({int.from_bytes(hashlib.sha256(f"{g}{i}s".encode()).digest(), "little") % size + offset for g in ("a", "bc", "ü") for i in (0, 1)})
        got = {r.id: (r.x, r.c) for r in df.select("id", b.indices(F.col("f")).alias("x"), b.collision_fraction(F.col("f")).alias("c")).collect()}
        assert got[1][0] == want and got[2] == got[3] == ([], 0.0)


def test_thresholds_of_null_ids_and_repeats(spark):
    e = Embedder()
    df = spark.createDataFrame([(1, [1, 2, 2]), (None, [1, 2]), (2, [1, 2, 3]), (2**60 + 1, [9]), (2**60, [9])], "id bigint, bf_indices array<int>")
    made = Embedded.from_df(df, e, "id", update_thresholds=True)
    got = {r.id: (round(r.bf_norms, 6), r.thresholds) for r in made.df.collect()}
    assert got[1][0] == got[None][0] == 1.414214 and got[None][1] is None
    assert abs(got[1][1] - 2 / 6**0.5) < 1e-9 and got[2**60][1] == got[2**60 + 1][1] == 1.0
    again = Embedded.from_df(made.df, e, "id", update_thresholds=True)  # a table that has thresholds already
    assert {r.id: r.thresholds for r in again.df.collect()} == {k: v[1] for k, v in got.items()}


def test_checksum_knows_functions():
    one, two = (Embedder(factory={"own": f}) for f in (lambda **_: (lambda c: F.array(F.upper(c))), lambda **_: (lambda c: F.array(F.lower(c)))))
    same = Embedder(factory={"own": lambda **_: (lambda c: F.array(F.upper(c)))})
    assert one.checksum != two.checksum and one.checksum == same.checksum


@pytest.mark.parametrize("width, most", [(1024, 90), (1000, 300), (77, 20), (2048, 900)])
def test_folds_lose_no_pair(spark, width, most):
    r = np.random.default_rng(width)
    base = [r.choice(width, r.integers(0, most), replace=False) for _ in range(20)]
    lists = [[int(p) for p in base[k % 20] if r.random() < 0.8] + [int(p) for p in r.integers(0, width, k % 7)] for k in range(400)]
    e = Embedder(BloomFilter(width))
    df = spark.createDataFrame([(f"k{k // 2 if k < 20 else k}", x) for k, x in enumerate(lists)], "id string, bf_indices array<int>")
    x = Embedded.from_df(df, e, "id")
    m = np.zeros((400, width))
    for k, v in enumerate(lists):
        m[k, v] = 1
    n = m.sum(1)
    root = np.sqrt(np.outer(n, n))
    sim = np.divide(m @ m.T, root, out=np.zeros_like(root), where=root > 0)
    ids = np.array([f"k{k // 2 if k < 20 else k}" for k in range(400)])
    for rows in (4096, 64):
        for least in (0.3, 0.6):
            i, j = np.nonzero(sim >= least)
            got = sorted((r.id1, r.id2, r.sim) for r in compare(e, x, x, require_thresholds=False, least=least, block_rows=rows).collect())
            assert got == sorted(zip(ids[i].tolist(), ids[j].tolist(), sim[i, j].tolist()))
        others = np.where(ids[:, None] == ids[None, :], -np.inf, sim)
        got = {r.id: r.thresholds for r in e.with_thresholds(x, block_rows=rows).df.collect()}
        assert got == {k: others[ids == k].max() for k in set(ids.tolist())}


def test_blocks_are_not_copied_for_each_other(spark, toy):
    e, x, y = toy
    for least in (None, 0.5):
        plan = compare(e, x, y, least=least, block_rows=1)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Exchange" not in plan and "Cogroup" not in plan


@pytest.mark.parametrize("seed", range(2))
def test_exact_by_prices_has_the_largest_total(spark, seed, monkeypatch):
    from veilink.operators import link

    r = np.random.default_rng(seed)
    e = Embedder(BloomFilter(128))
    sides = []
    for n in (90, 70):
        lists = [[int(p) for p in r.choice(64 * (1 + k % 2), r.integers(0, 14))] for k in range(n)]
        df = spark.createDataFrame(list(enumerate(lists)), "id int, bf_indices array<int>")
        sides.append(Embedded.from_df(df, e, "id"))
    pairs = compare(e, *sides, require_thresholds=False, block_rows=30)
    options = {"require_thresholds": False, "abs_cutoff": 0.0}
    whole = match(pairs, **options).collect()
    monkeypatch.setattr(link, "WHOLE_CELLS", 0)
    monkeypatch.setattr(link, "NEAREST", 2)
    monkeypatch.setattr(link, "_exact", None)  # what holds the matrix isn't called
    got = match(pairs, **options).collect()
    assert abs(sum(x.sim for x in got) - sum(x.sim for x in whole)) < 1e-6
    assert len(got) == len(whole) == len({x.id1 for x in got}) == len({x.id2 for x in got}) == 70
    scores = {(x.id1, x.id2): x.sim for x in pairs.collect()}
    assert all(scores[x.id1, x.id2] == x.sim for x in got)


def test_indexed_in_blocks(spark):
    r = np.random.default_rng(5)
    e = Embedder(BloomFilter(64))
    df = spark.createDataFrame([(k, [int(p) for p in r.integers(0, 64, k % 12)]) for k in range(60)], "id int, bf_indices array<int>")
    x = Embedded.from_df(df, e, "id")
    got = compare_indexed(x, x)
    assert "CartesianProduct" in got._jdf.queryExecution().executedPlan().toString()  # no join of over as many entries as pairs
    want = {(y.id1, y.id2): y.sim for y in compare(e, x, x, require_thresholds=False).collect() if y.sim > 0}
    assert {(y.id1, y.id2): y.sim for y in got.collect()} == want


def test_prices_prove_the_sparse_assignment():
    from veilink.operators.assign import assign_priced

    r = np.random.default_rng(1)
    for _ in range(60):
        n, m = r.integers(1, 9, 2)
        w = np.round(r.random((n, m)), int(r.integers(1, 4))) * (r.random((n, m)) < 0.7)
        i, j = np.nonzero(w > 0)
        k, u, v = assign_priced(i, j, w[i, j], n, m)
        assert abs(u.sum() + v.sum() - w[i[k], j[k]].sum()) < 1e-9 and (w - u[:, None] - v[None, :] < 1e-9).all()
