"""Feature strings and Bloom filters against known values and a plain-Python model."""

import hashlib
import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilink.functions import features as X
from veilink.functions.bloom import BloomFilter
from veilink.functions.phonetic import double_metaphone

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def values(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    return [r[0] for r in df.select(column(F.col("x")).alias("v"), "i").orderBy("i").collect()]


def model(text, lengths=(2, 3), skip=False):
    toks = [f"_{w}_" for w in re.split(r"[\s+\-_,.]+", (text or "").lower()) if w]
    out = [t[i : i + n] for n in lengths for t in toks for i in range(len(t) - n + 1)]
    out = [g for g in out if g != "_"]
    return out + ([t[i] + t[i + 2] for t in toks for i in range(len(t) - 2)] if skip else [])


def test_tokens(spark):
    assert values(spark, ["mira  tobias lind", "Teodora__Brand-D'Arco", "", None, " +-_,. ", "a b"], X.tokens) == [
        ["_mira_", "_tobias_", "_lind_"], ["_Teodora_", "_Brand_", "_D'Arco_"], [], [], [], ["_a_", "_b_"]
    ]


def test_grams(spark):
    one = spark.createDataFrame([(["dave", "wilson"], ["ron", "bill"])], "a array<string>, b array<string>")
    r = one.select(X.ngrams(F.col("a"), (2, 5)), X.ngrams(F.col("b"), (1,)), X.skip_grams(F.col("a")), X.skip_grams(F.col("b")), X.ngrams(F.col("a"), ())).first()
    assert set(r[0]) == set("da av ve wi il ls so on wilso ilson".split())
    assert r[1] == list("ronbill")
    assert r[2] == "dv ae wl is lo sn".split() and r[3] == "rn bl il".split() and r[4] == []


@SLOW
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\x00"), max_size=12), min_size=1, max_size=20))
def test_strings_against_model(spark, texts):
    got = values(spark, texts, lambda c: X.string_features(c, (1, 2, 3), True, True))
    for text, features in zip(texts, got):
        if text.lower() == unicodedata.normalize("NFC", text).lower() and text.isascii():
            assert features == model(text, (1, 2, 3), True)
        assert all(features)


def test_all_name_features(spark):
    got = values(spark, ["dave wilson", "ron bill", None, ""], X.name_features(ngram_length=[2], use_gen_skip_grams=True, use_double_metaphone=True))
    assert got[0] == "_d da av ve e_ _w wi il ls so on n_ _a dv ae v_ _i wl is lo sn o_ TF ALSN FLSN".split()
    assert got[1] == "_r ro on n_ _b bi il ll l_ _o rn o_ _i bl il l_ RN PL".split()
    assert got[2:] == [[], []]


def test_sex(spark):
    assert values(spark, ["Ostrich", "Male", None, "female", ""], X.sex_features()) == [["sex<o>"], ["sex<m>"], [""], ["sex<f>"], [""]]


def test_dates(spark):
    got = values(spark, ["01/03/2012", "12/25/1993", "11/12/1960", "", None, "1/3/2012", "1977-03-23", "15 Oct 1998"], X.date_features(default=["none"]))
    assert got[0] == got[5] == ["day<01>", "month<03>", "year<2012>"]
    assert got[1] == got[3] == got[4] == ["none"]
    assert got[2] == ["day<11>", "month<12>", "year<1960>"] and got[6] == ["day<23>", "month<03>", "year<1977>"] and got[7][1] == "month<10>"
    assert values(spark, ["12/25/1993"], X.date_features(dayfirst=False)) == [["day<25>", "month<12>", "year<1993>"]]
    with pytest.raises(TypeError):
        X.date_features(default="missing")


def test_misc_and_shingled(spark):
    assert values(spark, ["a", "Straße", "", None, "NO_DATA", "ΣΑΣ"], X.misc_features("foo")) == [["foo<a>"], ["foo<strasse>"], [], [], [], ["foo<σασ>"]]
    assert values(spark, ["ab", None], X.shingled_features((1, 2))) == [["zz<a>", "zz<b>", "zz<_a>", "zz<ab>", "zz<b_>"], []]


def test_case_folding_of_letters(spark):
    letters = [chr(i) for i in range(0x20, 0x2000) if chr(i).isalpha()]
    got = values(spark, letters, X.case_folded)
    assert len([1 for c, g in zip(letters, got) if g != c.casefold()]) <= 180  # Cherokee and letters newer than the JVM's tables


@pytest.mark.parametrize("word,codes", [("dave", ("TF", "")), ("wilson", ("ALSN", "FLSN")), ("ron", ("RN", "")), ("bill", ("PL", "")), ("Smith", ("SM0", "XMT")), ("Schmidt", ("XMT", "SMT")), ("Laugh", ("LF", "")), ("", ("", ""))])
def test_double_metaphone(word, codes):
    assert double_metaphone(word) == codes


def test_bloom_known_values(spark):
    one = spark.createDataFrame([(["a", "b", "c"],), ([],), (None,), (["a", "a"],)], "f array<string>")
    got = [r[0] for r in one.select(BloomFilter().indices(F.col("f"))).collect()]
    assert got[0] == sorted({334, 1013, 192, 381, 18, 720}) and got[1] == [] and got[2] == [] and len(got[3]) == 2
    fractions = [r[0] for r in one.select(BloomFilter().collision_fraction(F.col("f"))).collect()]
    assert fractions == [0.0, 0.0, 0.0, 0.5]


@SLOW
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\x00"), max_size=5), max_size=6), st.sampled_from([2, 64, 100, 1024, 65536]), st.integers(0, 3), st.integers(0, 50), st.text("abc", max_size=3))
def test_bloom_against_model(spark, features, size, hashes, offset, salt):
    want = {int.from_bytes(hashlib.sha256(f"{g}{i}{salt}".encode()).digest(), "little") % size + offset for g in features for i in range(hashes)}
    one = spark.createDataFrame([(features,)], "f array<string>")
    assert one.select(BloomFilter(size, hashes, offset, salt).indices(F.col("f"))).first()[0] == sorted(want)


def test_phonetic_context_rules():
    # published examples of the rules
    for word, codes in {"gallegos": ("KLKS", "KKS"), "bacchus": ("PKS", ""), "island": ("ALNT", ""), "accident": ("AKSTNT", ""), "bellocchio": ("PLX", ""), "cabrillo": ("KPRL", "KPR"), "thomas": ("TMS", "")}.items():
        assert double_metaphone(word) == codes, word


@pytest.mark.parametrize("size, hashes, offset", [(1000, 2, 7), (1024, 3, 0), (77, 1, 0), (10, 0, 0)])
def test_indices_of_a_table_are_those_of_the_expression(spark, size, hashes, offset):
    rows = [(1, ["ab", "b_", "ab"]), (2, []), (3, None), (4, ["é", "", "ab"])]
    df = spark.createDataFrame(rows, "id int, f array<string>")
    bloom = BloomFilter(size, hashes, offset, "x")
    want = {r.id: r.i for r in df.select("id", bloom.indices(F.col("f")).alias("i")).collect()}
    got = bloom.with_indices(df, F.col("f"), "i")
    assert {r.id: r.i for r in got.collect()} == want and got.columns == ["id", "f", "i"]
