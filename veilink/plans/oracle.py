"""The same queries in SQL, as DuckDB reads it."""

from __future__ import annotations

SALT = "pepper"
# Fixed value: white space and separators, as RE2 reads them.
SEPARATORS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}+\-_,.]+"
HEX = "'0123456789abcdef'"


def lower(x: str) -> str:
    """Lower case with the final form of sigma at the end of a word."""
    return rf"regexp_replace(lower({x}), '(\pL)σ(\PL|$)', '\1ς\2', 'g')"


def tokens(x: str) -> str:
    return f"list_transform(list_filter(regexp_split_to_array(coalesce({x}, ''), '{SEPARATORS}'), lambda w: w <> ''), lambda w: '_' || w || '_')"


def ngrams(toks: str, *lengths: int) -> str:
    each = [
        f"flatten(list_transform({toks}, lambda t: CASE WHEN length(t) >= {n} THEN list_transform(range(1, length(t) - {n} + 2), lambda i: substr(t, i::BIGINT, {n})) ELSE []::VARCHAR[] END))"
        for n in lengths
    ]
    return f"list_filter({' || '.join(each)}, lambda g: g <> '_')"


def skip_grams(toks: str) -> str:
    return f"flatten(list_transform({toks}, lambda t: CASE WHEN length(t) >= 3 THEN list_transform(range(1, length(t) - 1), lambda i: substr(t, i::BIGINT, 1) || substr(t, (i + 2)::BIGINT, 1)) ELSE []::VARCHAR[] END))"


def names(x: str) -> str:
    return ngrams(tokens(lower(x)), 2, 3)


def sex(x: str) -> str:
    return f"[CASE WHEN coalesce({x}, '') = '' THEN '' ELSE 'sex<' || lower(substr({x}, 1, 1)) || '>' END]"


def dates(x: str, default: str = "[]::VARCHAR[]") -> str:
    day = "coalesce(" + ", ".join(f"try_strptime(trim({x}), '{f}')" for f in ("%d/%m/%Y", "%d.%m.%Y", "%Y-%m-%d", "%d %b %Y")) + ")"
    return f"CASE WHEN {day} IS NULL THEN {default} ELSE [strftime({day}, 'day<%d>'), strftime({day}, 'month<%m>'), strftime({day}, 'year<%Y>')] END"


def misc(x: str, label: str) -> str:
    return f"CASE WHEN coalesce(lower({x}), '') IN ('', 'no_data') THEN []::VARCHAR[] ELSE ['{label}<' || lower({x}) || '>'] END"


def shingled(x: str, label: str) -> str:
    return f"list_transform({names(x)}, lambda g: '{label}<' || g || '>')"


def raw_indices(features: str) -> str:
    """Index of each feature under two hashes: the first two digest bytes, the second the higher."""
    digit = lambda p: f"(strpos({HEX}, substr(h, {p}, 1)) - 1)"
    index = f"(({digit(3)} * 16 + {digit(4)}) * 256 + {digit(1)} * 16 + {digit(2)}) % 1024"
    return f"list_transform(flatten(list_transform({features}, lambda g: [sha256(g || '0{SALT}'), sha256(g || '1{SALT}')])), lambda h: {index})"


def indices(features: str) -> str:
    return f"list_sort(list_distinct({raw_indices(features)}))"


def odd_indices(features: str, size: int, offset: int) -> str:
    """As ``indices`` for any size: the digest read last byte first, one digit after the other."""
    value = f"list_reduce(list_prepend(0::BIGINT, list_transform(range(32, 0, -1), lambda k: ((strpos({HEX}, substr(h, (2 * k - 1)::BIGINT, 1)) - 1) * 16 + strpos({HEX}, substr(h, (2 * k)::BIGINT, 1)) - 1)::BIGINT)), lambda x, y: (x * 256 + y) % {size})"
    return f"list_sort(list_distinct(list_transform(flatten(list_transform({features}, lambda g: [sha256(g || '0{SALT}'), sha256(g || '1{SALT}')])), lambda h: {value} + {offset})))"


def text(x: str) -> str:
    return f"coalesce(array_to_string({x}, '|'), '')"


A_FEATURES = f"list_distinct({names('first_name')} || {names('last_name')} || {sex('gender')} || {dates('date_of_birth')} || {shingled('instrument', 'instrument')} || {misc('county', 'county')})"
B_FEATURES = f"list_distinct({names('name')} || {sex('sex')} || {dates('birth_date')} || {shingled('main_instrument', 'instrument')} || {misc('county', 'county')})"
PEOPLE_A = f"pa AS (SELECT *, {A_FEATURES} AS f FROM (SELECT DISTINCT id, first_name, last_name, gender, date_of_birth, instrument, county FROM df1))"
PEOPLE_B = f"pb AS (SELECT *, {B_FEATURES} AS f FROM (SELECT DISTINCT personid, name, sex, birth_date, main_instrument, county FROM df2))"
EMBEDDED_A = f"{PEOPLE_A}, ea AS MATERIALIZED (SELECT *, {indices('f')} AS x FROM pa)"
EMBEDDED_B = f"{PEOPLE_B}, eb AS MATERIALIZED (SELECT *, {indices('f')} AS x FROM pb)"


def bits(name: str, source: str, key: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT {key} AS k, bitstring_agg(p, 0, 1023) AS b, count(*)::DOUBLE AS n FROM (SELECT {key}, unnest(x)::INTEGER AS p FROM {source}) GROUP BY {key})"


def sim(a: str, b: str) -> str:
    return f"bit_count({a}.b & {b}.b) / sqrt({a}.n * {b}.n)"


SUPPLIER_FEATURES = f"list_distinct({names('s_name')} || {misc('nation', 'county')} || {shingled('balance', 'instrument')})"
SUPPLIERS = f"""s AS (SELECT s_suppkey, s_name, s_nationkey::VARCHAR AS nation, s_acctbal::VARCHAR AS balance FROM supplier),
 s2 AS (SELECT s_suppkey + 1000000 AS other, CASE WHEN s_suppkey % 3 = 0 THEN replace(s_name, '0', ' ') ELSE s_name END AS s_name, nation, balance FROM s),
 e1 AS MATERIALIZED (SELECT s_suppkey, {indices(SUPPLIER_FEATURES)} AS x FROM s), e2 AS MATERIALIZED (SELECT other, {indices(SUPPLIER_FEATURES)} AS x FROM s2),
 {bits('b1', 'e1', 's_suppkey')}, {bits('b2', 'e2', 'other')}"""
FLAGSHIP = f"list_distinct({ngrams(tokens(lower('s_name')), 1, 2, 3, 4)} || {skip_grams(tokens(lower('s_name')))} || {misc('nation', 'nation')})"
SELF = "SELECT l.k, max({sim}) AS th FROM {b} l JOIN {b} r ON l.k <> r.k GROUP BY l.k"

# each supplier's most similar partner; these are all different, so together they are the best assignment
BEST = f"""WITH {SUPPLIERS}, t1 AS ({SELF.format(sim=sim('l', 'r'), b='b1')}), t2 AS ({SELF.format(sim=sim('l', 'r'), b='b2')}),
 m AS (SELECT l.k AS id1, arg_max(r.k, {sim('l', 'r')}) AS id2, max({sim('l', 'r')}) AS sim FROM b1 l CROSS JOIN b2 r GROUP BY l.k)"""

# Published phonetic codes of the words of part names.
CODES = "anvil ANFL, blue PL, bolt PLT, cold KLT, gear JR|KR, gizmo JSM|KSM, hot HT, large LRJ|LRK, new N|NF, old ALT, plate PLT, red RT, ring RNK, rod RT, small SML|XML, widget AJT|FJT"
CODE_ROWS = ", ".join("('{}', '{}')".format(*pair.split()) for pair in CODES.split(", "))

ORACLE_SQL: dict[str, str] = {
    "feat_tokens": f"SELECT p_partkey, {text(tokens('p_name'))} AS tokens FROM part",
    "feat_ngrams": f"SELECT p_partkey, {text(ngrams(tokens('p_name'), 1, 2, 3))} AS grams FROM part",
    "feat_skip_grams": f"SELECT p_partkey, {text(skip_grams(tokens('p_name')))} AS grams FROM part",
    "feat_double_metaphone": f"""WITH codes(w, c) AS (VALUES {CODE_ROWS}), words AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i FROM part)
 SELECT p_partkey, string_agg(c, '|' ORDER BY i) AS codes FROM words JOIN codes USING (w) GROUP BY p_partkey""",
    "feat_strings": f"SELECT p_partkey, {text(ngrams(tokens('lower(p_name)'), 2, 3) + ' || ' + skip_grams(tokens('lower(p_name)')))} AS features FROM part",
    "feat_names": f"SELECT personid, {text(names('name'))} AS features FROM (SELECT DISTINCT personid, name, sex, birth_date, main_instrument, county FROM df2)",
    "feat_sex": f"SELECT id, {text(sex('gender'))} AS features, CAST(1 AS BIGINT) AS n FROM (SELECT DISTINCT id, first_name, last_name, gender, date_of_birth, instrument, county FROM df1)",
    "feat_dates": f"SELECT id, {text(dates('date_of_birth', chr(91) + chr(39) + 'missing' + chr(39) + chr(93)))} AS features FROM (SELECT DISTINCT id, first_name, last_name, gender, date_of_birth, instrument, county FROM df1)",
    "feat_misc": f"SELECT o_orderkey, {text(misc('o_orderpriority', 'priority'))} AS features FROM orders",
    "feat_shingled": f"SELECT id, {text(shingled('instrument', 'instrument'))} AS features FROM (SELECT DISTINCT id, first_name, last_name, gender, date_of_birth, instrument, county FROM df1)",
    "feat_user": "SELECT p_partkey, upper(p_name) AS features FROM part",
    "bloom_indices": f"SELECT c_custkey, {text(indices(names('c_name')))} AS indices FROM customer",
    "bloom_odd_size": f"SELECT c_custkey, {text(odd_indices(names('c_name'), 1000, 7))} AS indices FROM customer",
    "bloom_collisions": f"SELECT c_custkey, round(1 - len(list_distinct(r)) / len(r)::DOUBLE, 6) AS fraction FROM (SELECT c_custkey, {raw_indices(names('c_name'))} AS r FROM customer)",
    "embed_columns": f"WITH {EMBEDDED_A} SELECT id, len(f) AS features, {text('x')} AS indices, round(sqrt(len(x)::DOUBLE), 6) AS bf_norms FROM ea",
    "anonymised": f"WITH {EMBEDDED_A} SELECT id, county, {text('x')} AS indices, round(sqrt(len(x)::DOUBLE), 6) AS bf_norms FROM ea",
    "embed_flagship": f"""WITH s AS (SELECT s_suppkey, s_name, s_nationkey::VARCHAR AS nation FROM supplier), e AS MATERIALIZED (SELECT s_suppkey, {indices(FLAGSHIP)} AS x FROM s),
 {bits('b', 'e', 's_suppkey')}, th AS ({SELF.format(sim=sim('l', 'r'), b='b')})
 SELECT s_suppkey, {text('x')} AS indices, round(sqrt(len(x)::DOUBLE), 6) AS bf_norms, round(th, 6) AS thresholds FROM e JOIN th ON k = s_suppkey""",
    "thresholds": f"WITH {EMBEDDED_A}, {bits('b', 'ea', 'id')} SELECT k AS id, round(th, 6) AS thresholds FROM ({SELF.format(sim=sim('l', 'r'), b='b')})",
    "compare_pairs": f"WITH {EMBEDDED_A}, {EMBEDDED_B}, {bits('b1', 'ea', 'id')}, {bits('b2', 'eb', 'personid')} SELECT l.k AS id1, r.k AS id2, round({sim('l', 'r')}, 6) AS sim FROM b1 l CROSS JOIN b2 r WHERE {sim('l', 'r')} >= 0.6",
    "compare_all": f"WITH {SUPPLIERS} SELECT l.k AS id1, r.k AS id2, round({sim('l', 'r')}, 6) AS sim FROM b1 l CROSS JOIN b2 r",
    "compare_by_index": f"WITH {SUPPLIERS} SELECT l.k AS id1, r.k AS id2, round({sim('l', 'r')}, 6) AS sim FROM b1 l CROSS JOIN b2 r WHERE bit_count(l.b & r.b) > 0",
    "match_many": f"""WITH {EMBEDDED_A}, {EMBEDDED_B}, {bits('b1', 'ea', 'id')}, {bits('b2', 'eb', 'personid')},
 t1 AS ({SELF.format(sim=sim('l', 'r'), b='b1')}), t2 AS ({SELF.format(sim=sim('l', 'r'), b='b2')})
 SELECT l.k AS id1, r.k AS id2, round({sim('l', 'r')}, 6) AS sim FROM b1 l CROSS JOIN b2 r JOIN t1 ON t1.k = l.k JOIN t2 ON t2.k = r.k WHERE {sim('l', 'r')} >= 0.6 AND {sim('l', 'r')} >= t1.th AND {sim('l', 'r')} >= t2.th""",
    "match_exact": f"{BEST} SELECT id1, id2, round(sim, 6) AS sim FROM m JOIN t1 ON t1.k = id1 JOIN t2 ON t2.k = id2 WHERE sim >= t1.th AND sim >= t2.th",
    "matched_parties": f"{BEST} SELECT id1 AS s_suppkey, id2 AS other FROM m JOIN t1 ON t1.k = id1 JOIN t2 ON t2.k = id2 WHERE sim >= t1.th AND sim >= t2.th",
    "csv_round_trip": "SELECT id, coalesce(first_name, '') AS first_name, coalesce(last_name, '') AS last_name, coalesce(gender, '') AS gender, coalesce(date_of_birth, '') AS date_of_birth, coalesce(instrument, '') AS instrument, coalesce(county, '') AS county FROM (SELECT DISTINCT id, first_name, last_name, gender, date_of_birth, instrument, county FROM df1)",
    "json_round_trip": f"SELECT c_custkey, {text('x')} AS indices, round(sqrt(len(x)::DOUBLE), 6) AS bf_norms FROM (SELECT c_custkey, {indices(names('c_name'))} AS x FROM customer)",
    "shared_bundle": f"SELECT c_custkey, {text(indices(names('c_name')))} AS indices, CAST(3 AS BIGINT) AS columns, true AS same_embedder FROM customer",
    "saved_embedder": f"SELECT c_custkey, {text(indices(names('c_name')))} AS indices FROM customer",
    "private_index_invariants": "SELECT CAST(2 * count(*) AS BIGINT) AS records, CAST(2 AS BIGINT) AS most, CAST(0 AS BIGINT) AS repeated, CAST(0 AS BIGINT) AS outside FROM supplier",
    "match_performance": f"""WITH {SUPPLIERS}, m AS (SELECT l.k AS a, r.k - 1000000 AS b FROM b1 l CROSS JOIN b2 r WHERE {sim('l', 'r')} >= 0.9), n AS (SELECT count(*) AS possible FROM supplier)
 SELECT count(*) AS matches, count(*) FILTER (a = b) AS true_positives, count(*) FILTER (a <> b) AS false_positives, any_value(possible) AS possible,
 round(count(*) FILTER (a = b) / count(*)::DOUBLE, 6) AS precision, round(count(*) FILTER (a = b) / any_value(possible)::DOUBLE, 6) AS recall FROM m CROSS JOIN n""",
    "joint_freq": f"""WITH {SUPPLIERS}, c AS (SELECT i, unnest(y) AS j FROM (SELECT unnest(e1.x) AS i, e2.x AS y FROM e1 JOIN e2 ON e2.other = e1.s_suppkey + 1000000)), n AS (SELECT i, j, count(*) AS n FROM c GROUP BY i, j)
 SELECT i::INTEGER AS i, j::INTEGER AS j, sum(n) / 2.0::DOUBLE AS count FROM (SELECT i, j, n FROM n UNION ALL SELECT j, i, n FROM n) GROUP BY i, j""",
    "encrypted_round_trip": "SELECT c_custkey, c_name, c_mktsegment FROM customer",
    "embed_streamed": f"SELECT c_custkey, {text('x')} AS indices, round(sqrt(len(x)::DOUBLE), 6) AS bf_norms FROM (SELECT c_custkey, {indices(names('c_name'))} AS x FROM customer)",
}
