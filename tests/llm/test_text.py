"""Shared spans, encoding, look-alikes and mixing against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from veilink.llm import lookalike, mixture, spans, tokens

DOCS = "doc_id bigint, text string, doc string, lo int, source string, lang string"


def documents(seed=3, n=40):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéß😀 \n") for _ in range(r.randint(2, 9)))
    fresh = lambda k: " ".join(word() for _ in range(k))
    quotes = [fresh(r.randint(10, 90)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [fresh(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            q = r.choice(quotes)
            a = r.randint(0, len(q) // 3)
            parts += [q[a:] if r.random() < 0.5 else q, fresh(r.randint(0, 40))]
        rows.append((i, "".join(parts), "x", 1, r.choice(["a", "b", None]), None))
    rows += [(100, None, "", 0, "a", "en"), (101, "", "", 0, "a", "en"), (102, "  ", "", 0, "a", "en"), (103, "abc " * 400, "", 0, "b", "en"), (104, rows[0][1], "", 0, "b", "en"), (105, "abc " * 90, "", 0, "b", "en")]
    return rows


def brute_spans(rows, least):
    seen = {}
    for d, t, *_ in rows:
        for i in range(len(t or "") - least + 1):
            seen.setdefault(t[i : i + least], set()).add(d)
    out = set()
    for d, t, *_ in rows:
        covered = set()
        for i in range(len(t or "") - least + 1):
            if len(seen[t[i : i + least]]) > 1:
                covered |= set(range(i, i + least))
        for i in sorted(covered):
            if i - 1 not in covered:
                start = i
            if i + 1 not in covered:
                out.add((d, start, i + 1))
    return out


@pytest.mark.parametrize("seed,least,seeds", [(3, 200, 32), (4, 60, 12), (5, 31, 8)])
def test_shared_spans(spark, seed, least, seeds):
    rows = documents(seed)
    docs = spark.createDataFrame(rows, DOCS)
    got = [tuple(r) for r in spans.shared_spans(docs, min_chars=least, seed_chars=seeds).collect()]
    assert sorted(got) == sorted(tuple(r) for r in spans.shared_spans(docs, min_chars=least, seed_chars=seeds, group_pieces=1, task_chars=500).collect())  # all groups hot
    assert len(got) == len(set(got)) and set(got) == brute_spans(rows, least)


def test_hot_groups_take_another_way(spark):
    rows = [(i, f"{i:03d}" * 9 + "common text " * 30 + f"{i * 7:04d}" * 8, "", 0, None, None) for i in range(60)]
    df = spark.createDataFrame(rows, DOCS)
    got = {tuple(r) for r in spans.shared_spans(df, min_chars=80, seed_chars=16, broadcast_rows=0).collect()}
    assert got == brute_spans(rows, 80)


def test_fraction_and_empty(spark):
    df = spark.createDataFrame(documents(), DOCS)
    r = {x.doc_id: x for x in spans.shared_fraction(df, spans.shared_spans(df)).collect()}
    assert r[100].n_chars == r[101].n_chars == 0 and r[100].shared_fraction == 0 and r[104].shared_fraction > 0
    assert spans.shared_spans(df.limit(0)).count() == 0
    assert spans.shared_spans(df.where("doc_id = 103")).count() == 0  # repeated only in itself


ODD = ["<|endoftext|>", "naïve  　 x\r\n\r\n it's  '''S 1234½ 😀😀 don't​x", "", None, " ", "\n\n\t a", "x" * 300, "ffi ﬃ ́a", "\x00a\x00", "日本語テキスト", "a" * 5 + "  " * 40 + "b"]


def test_encoding(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(tokens.vocabulary_path())
    t.encode_special_tokens = True
    rows = [(i, x, "d", 0, None, None) for i, x in enumerate(ODD + [r[1] for r in documents()])]
    df = spark.createDataFrame(rows, DOCS)
    for words in (4, 8192):
        made = tokens.encode_corpus(df, dictionary_words=words)
        for r in made.collect():
            assert r.ids == t.encode(r.text or "", add_special_tokens=False).ids
    assert made.where(~tokens.decode_ids(F.col("ids")).eqNullSafe(F.coalesce("text", F.lit("")))).count() == 0
    counted = tokens.count_tokens(df).select("doc_id", "n_tokens").collect()
    assert {r.doc_id: r.n_tokens for r in counted} == {r.doc_id: len(r.ids) for r in made.collect()}
    assert tokens.encode_corpus(df.limit(0)).count() == 0


def test_visible_form_and_repair():
    words = {"François", "Anna-Lena", "Орлов", "Νίκος", "Rosa", "O'Neil", "de la Cruz"}
    for value, want in [
        ("François", "François"), ("Ｆrançois", "François"), ("Anna‑Lena", "Anna-Lena"), ("Anna­Lena", "AnnaLena"), ("Ro​sa ", "Rosa"), ("Rоsа", "Rosa"), ("Rοsa", "Rosa"),
        ("Oрлов", "Орлов"), ("Nίκος", "Νίκος"), ("O＇Neil", "O'Neil"), ("de la　Cruz", "de la Cruz"), ("rosa", "rosa"), ("Rósa", "Rósa"), (None, None), ("", ""), ("​", ""), ("Rosa", "Rosa"),
    ]:
        assert lookalike.repair(value, words) == want, value
    assert lookalike.forms_of("123") == ["123"] and lookalike.in_script("Ж", "LATIN") is None


def test_found_lookalikes(spark):
    people = spark.createDataFrame([(1, "Rоsa", "Cruz", "x"), (1, "Rоsa", "Cruz", "x"), (2, None, "", "y"), (3, "Rosa", "Rоsa", "z"), (4, "ROSA", "Ｃｒｕｚ", "k")], "id int, first_name string, last_name string, kind string")
    names = spark.createDataFrame([(10, "first", "Rosa"), (11, "first", "Rosa"), (12, "last", "Cruz"), (13, None, None)], "name_id int, kind string, listed_name string")
    assert {tuple(r) for r in lookalike.found_lookalikes(people, names).collect()} == {(1, "first_name", 10), (4, "last_name", 12)}
    assert lookalike.found_lookalikes(people.limit(0), names).count() == 0 and lookalike.found_lookalikes(people, names.limit(0)).count() == 0
    # seven tokens, each with a form in several scripts, the last listed in Greek
    wide = spark.createDataFrame([(1, "ＡＢ ＡＢ ＡＢ ＡＢ ＡＢ ＡＢ ＡＢ")], "id int, first_name string").withColumn("last_name", F.lit(None).cast("string"))
    greek = spark.createDataFrame([(7, "first", "AB AB AB AB AB AB ΑΒ"), (8, "first", "AB AB")], "name_id int, kind string, listed_name string")
    assert [tuple(r) for r in lookalike.found_lookalikes(wide, greek).collect()] == [(1, "first_name", 7)]


def test_repairs_by_join_equal_repairs_one_by_one(spark):
    words = ["Rosa", "Rоза", "AB", "ΑΒ", "de la Cruz", "O'Neil", "Νίκος"]
    values = ["Rоsa", "Ｒosa", "Rosa", "АB", "AΒ", "de lа Cruz", "O＇Neil", "x", "", "Nίκος", "ΑB ΑΒ"]
    df = spark.createDataFrame([("first", v) for v in values] * 2 + [("last", "Rоsa"), ("first", None)], "kind string, value string")
    names = spark.createDataFrame([("first", w) for w in words] + [("first", None)], "kind string, listed_name string")
    got = {(r.kind, r.value): r.repaired for r in lookalike.repair_values(df, names).collect()}
    assert got == {**{("first", v): lookalike.repair(v, set(words)) for v in values}, ("last", "Rоsa"): "Rоsa"}


def test_budgets_go_to_siblings_first():
    leaves = [(("a", "x"), 100), (("a", "y"), 10), (("b", "x"), 1000), (("c", "x"), 0)]
    got = mixture.budgets(leaves, {"a": 0.5, "b": 0.5, "c": 0.2}, {"a": 1, "b": 1, "c": 1}, 200)
    assert abs(got["a", "x"] + got["a", "y"] - 100) < 1e-6 and abs(got["b", "x"] - 100) < 1e-6
    got = mixture.budgets(leaves, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 1}, 400)  # a is short by 90, b takes it
    assert got["a", "x"] == 100 and got["a", "y"] == 10 and abs(got["b", "x"] - 290) < 1e-6
    got = mixture.budgets(leaves, {"a": 0.5, "b": 0.5}, {"a": 2, "b": 1}, None)  # the most at which none falls short
    assert abs(sum(got.values()) - 440) < 1e-6
    assert mixture.budgets([], {"a": 1.0}, {"a": 1}, None) == {}


def test_mixture(spark):
    r = random.Random(1)
    rows = [(i, " ".join(["word"] * r.randint(1, 60)), "d", 0, r.choice(["big"] * 8 + ["small", "none", None]), r.choice(["en", None])) for i in range(400)] + [(900, None, "", 0, "big", "en"), (901, "", "", 0, "big", "en")]
    docs = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 4), ("absent", 0.1, 3)], "source string, target_share double, max_repeats int")
    used = mixture.mix_sources(docs, targets)
    got = {x.doc_id: x for x in used.collect()}
    assert all(x.source in ("big", "small") and 1 <= x.copies <= (4 if x.source == "small" else 1) for x in got.values()) and 900 not in got
    report = {x.source: x for x in mixture.mix_report(used, targets).collect()}
    assert abs(report["big"].reached_share - 2 / 3) < 0.02 and abs(report["small"].reached_share - 1 / 3) < 0.02 and report["absent"].tokens == 0
    assert {x.doc_id: x.copies for x in mixture.mix_sources(docs.repartition(7), targets).collect()} == {k: x.copies for k, x in got.items()}
    assert mixture.mix_sources(docs.limit(0), targets).count() == 0 and mixture.mix_sources(docs, targets.limit(0)).count() == 0
