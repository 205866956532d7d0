"""DuckDB SQL for the queries of the catalog, written from their definitions and apart from the operators."""

from __future__ import annotations

from itertools import combinations

GEO = ["n_name", "n_regionkey", "r_name", "c_mktsegment"]
ORDER_GEO = ["o_orderstatus", "o_orderpriority", "c_mktsegment", "r_name"]
PARTS = ["p_brand", "p_type", "p_size", "p_name"]
WIDE = ["n_name", "n_nationkey", "r_name", "n_regionkey", "c_mktsegment", "c_nationkey"]

#: (left side, right side): attributes with values, None is a wildcard.
RULES = (
    ((("o_orderstatus", "F"),), ("o_orderpriority", "1-URGENT")),
    ((("c_mktsegment", "BUILDING"), ("o_orderstatus", None)), ("r_name", None)),
    ((("o_orderpriority", None), ("r_name", "ASIA")), ("o_orderstatus", None)),
    ((("c_mktsegment", None),), ("r_name", None)),
    ((("r_name", "EUROPE"),), ("c_mktsegment", "MACHINERY")),
    ((("o_orderstatus", "O"), ("r_name", "ASIA")), ("c_mktsegment", "BUILDING")),
)


def _text(rule) -> str:
    said = lambda i: f"{i[0]}={i[1] or '_'}"
    return f"({', '.join(map(said, rule[0]))}) => {said(rule[1])}"


RULE_TEXTS = tuple(_text(r) for r in RULES)

_GEO = "geo AS (SELECT c_custkey AS tid, n_name, n_regionkey, r_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
_ORDER_GEO = f"{_GEO}, og AS (SELECT o_orderkey AS tid, o_orderstatus, o_orderpriority, c_mktsegment, r_name FROM orders JOIN geo ON o_custkey = geo.tid)"
_PARTS = "parts AS (SELECT p_partkey AS tid, p_brand, p_type, p_size, p_name FROM part)"


def _t(a: str) -> str:
    return f"coalesce(CAST({a} AS VARCHAR), 'NULL')"


def _all(selects: list[str]) -> str:
    return "\nUNION ALL ".join(selects)


def _items(base: str, attributes: list[str]) -> str:
    return _all([f"SELECT '{a}' AS attr, {_t(a)} AS value, count(*) AS n FROM {base} GROUP BY {_t(a)}" for a in attributes])


def _candidates(attributes: list[str], largest: int):
    ordered = sorted(attributes)
    return [(x, a) for k in range(1, largest + 1) for x in combinations(ordered, k) for a in ordered if a not in x]


def _classes(base: str, x, a: str) -> str:
    xs = ", ".join(f"{_t(c)} AS {c}" for c in x)
    names = ", ".join(x)
    return f"(SELECT {names}, sum(n) AS n, max(n) AS most, min(a) AS low, max(a) AS high FROM (SELECT {xs}, {_t(a)} AS a, count(*) AS n FROM {base} GROUP BY ALL) v GROUP BY {names}) c"


def _fds(base: str, attributes: list[str], largest: int) -> str:
    return _all([f"SELECT '{','.join(x)}' AS lhs, '{a}' AS rhs, count(*) AS n_classes, CAST(sum(n) AS BIGINT) AS support, CAST(sum(most) AS BIGINT) AS hits FROM {_classes(base, x, a)}" for x, a in _candidates(attributes, largest)])


def _pattern(attributes: list[str], of: dict[str, str]) -> str:
    return ", ".join(f"{of.get(a, 'CAST(NULL AS VARCHAR)')} AS p_{a}" for a in sorted(attributes))


def _variable(base: str, attributes: list[str], largest: int, support: int, confidence: float) -> str:
    out = []
    for x, a in _candidates(attributes, largest):
        for bits in range((1 << len(x)) - 1):
            constants = [c for k, c in enumerate(x) if bits >> k & 1]
            pattern = _pattern(attributes, {c: c if c in constants else "'_'" for c in x})
            group = f"GROUP BY {', '.join(constants)} " if constants else ""
            out.append(f"SELECT {pattern}, '{a}' AS rhs, CAST(NULL AS VARCHAR) AS rv, 'variable' AS kind, {len(x)} AS lhs_size, CAST(sum(n) AS BIGINT) AS support, CAST(sum(most) AS BIGINT) AS hits FROM {_classes(base, x, a)} {group}HAVING sum(n) >= {support} AND min(low) <> max(high) AND sum(most) >= {confidence} * sum(n)")
    return _all(out)


def _constant(base: str, attributes: list[str], largest: int, support: int, confidence: float) -> str:
    out = []
    for x, a in _candidates(attributes, largest):
        xs = ", ".join(f"{_t(c)} AS {c}" for c in x)
        counts = f"(SELECT {xs}, {_t(a)} AS a, count(*) AS n FROM {base} GROUP BY ALL)"
        whole = f"sum(n) OVER (PARTITION BY {', '.join(x)})"
        out.append(f"SELECT {_pattern(attributes, {c: c for c in x})}, '{a}' AS rhs, a AS rv, 'constant' AS kind, {len(x)} AS lhs_size, CAST(whole AS BIGINT) AS support, CAST(n AS BIGINT) AS hits FROM (SELECT *, {whole} AS whole FROM {counts} v) w WHERE whole >= {support} AND n >= {confidence} * whole")
    return _all(out)


def _minimal(rules: str, attributes: list[str]) -> str:
    general = " AND ".join(f"(e.p_{a} IS NULL OR (e.p_{a} = '_' AND r.p_{a} IS NOT NULL) OR e.p_{a} = r.p_{a})" for a in attributes)
    other = " OR ".join(f"e.p_{a} IS DISTINCT FROM r.p_{a}" for a in attributes)
    return f"SELECT * FROM {rules} r WHERE NOT EXISTS (SELECT 1 FROM {rules} e WHERE e.hits = e.support AND e.rhs = r.rhs AND e.rv IS NOT DISTINCT FROM r.rv AND {general} AND ({other}))"


def _rule(attributes: list[str]) -> str:
    left = ", ".join(f"'{a}=' || p_{a}" for a in sorted(attributes))
    return f"'(' || concat_ws(', ', {left}) || ') => ' || rhs || '=' || coalesce(rv, '_')"


def _shown(rules: str, attributes: list[str], more: str = "kind, lhs_size, support, hits, hits / support AS confidence") -> str:
    return f"SELECT {_rule(attributes)} AS rule, {more} FROM {rules}"


def _mined(base: str, attributes: list[str], largest: int, support: int, confidence: float, name: str = "mined") -> str:
    return f"{name}_all AS ({_variable(base, attributes, largest, support, confidence)}\nUNION ALL {_constant(base, attributes, largest, support, confidence)}), {name} AS ({_minimal(f'{name}_all', attributes)})"


def _matched(rules, base: str = "og") -> str:
    out = []
    for r in rules:
        where = " AND ".join([f"{_t(a)} = '{v}'" for a, v in r[0] if v] or ["true"])
        key = ", ".join(_t(a) for a, v in r[0] if not v)
        rv = f"'{r[1][1]}'" if r[1][1] else "CAST(NULL AS VARCHAR)"
        out.append(f"SELECT '{_text(r)}' AS rule_id, tid, CAST([{key}] AS VARCHAR[]) AS key, {_t(r[1][0])} AS rhs, {rv} AS rv FROM {base} WHERE {where}")
    return _all(out)


_VARIABLE, _CONSTANT = [r for r in RULES if not r[1][1]], [r for r in RULES if r[1][1]]
_MEASURES = f"""{_ORDER_GEO}, m AS ({_matched(RULES)}),
per AS (SELECT rule_id, rv, key, sum(n) AS n, max(n) AS most, sum(CASE WHEN rhs = rv THEN n ELSE 0 END) AS same
        FROM (SELECT rule_id, rv, key, rhs, count(*) AS n FROM m GROUP BY ALL) x GROUP BY rule_id, rv, key),
measures AS (SELECT rule_id, CAST(sum(n) AS BIGINT) AS support, CAST(sum(CASE WHEN rv IS NULL THEN most ELSE same END) AS BIGINT) AS hits FROM per GROUP BY rule_id)"""


def _brands(name: str, status: str | None = None) -> str:
    where = f" WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = '{status}')" if status else ""
    return f"{name} AS (SELECT list_sort(list(DISTINCT p_brand)) AS attrs FROM lineitem JOIN part ON l_partkey = p_partkey{where} GROUP BY l_orderkey)"


# a set as bits, so that all pairs can be compared
_BITS = "bits AS (SELECT p_brand, 1::HUGEINT << (row_number() OVER (ORDER BY p_brand) - 1)::INTEGER AS bit FROM (SELECT DISTINCT p_brand FROM part) b)"


def _coded(name: str, of: str) -> str:
    return f"{name} AS (SELECT attrs, sum(bit)::HUGEINT AS code FROM (SELECT attrs, unnest(attrs) AS p_brand FROM (SELECT DISTINCT attrs FROM {of}) d) u JOIN bits USING (p_brand) GROUP BY attrs)"


_UNCOVERED = f"{_BITS}, {_brands('f', 'F')}, {_brands('o', 'O')}, {_coded('t', 'f')}, {_coded('h', 'o')}, missed AS (SELECT attrs FROM t WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.code & t.code = t.code))"
_PAIRS = "pairs AS (SELECT a.vec_id AS id, a.embedding::DOUBLE[] AS u, b.embedding::DOUBLE[] AS v, a.label AS label, b.label AS other_label FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"
_DOT = "list_sum(list_transform(list_zip(u, v), lambda p: p[1] * p[2]))"
_COSINE = f"({_DOT} / (sqrt(list_sum(list_transform(u, lambda x: x * x))) * sqrt(list_sum(list_transform(v, lambda x: x * x)))))"


def _search(score: str, k: int, name: str = "found") -> str:
    return f"""met AS (SELECT q.vec_id AS query_id, c.vec_id AS corpus_id, q.embedding::DOUBLE[] AS u, c.embedding::DOUBLE[] AS v FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0),
scores AS (SELECT query_id, corpus_id, {score} AS score FROM met),
{name} AS (SELECT query_id, corpus_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_id) AS INTEGER) AS rank FROM scores QUALIFY rank <= {k})"""


_SCORED = f"scored AS (SELECT round({_COSINE}, 6) AS score, CAST(label = other_label AS INTEGER) AS label FROM pairs)"
_CURVE = f"""{_PAIRS}, {_SCORED},
dealt AS (SELECT score, count(*) AS rows_, sum(label) AS ones FROM scored GROUP BY score),
curve AS (SELECT score, sum(rows_) OVER w AS n, sum(ones) OVER w AS hit, lead(score) OVER (ORDER BY score DESC) AS next_,
                 (SELECT sum(label) FROM scored) AS pos, (SELECT count(*) FROM scored) AS total
          FROM dealt WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
cuts AS (SELECT *, (score + next_) / 2 AS threshold FROM curve WHERE next_ IS NOT NULL)"""
_LINES = ["l_discount", "l_extendedprice", "l_quantity", "l_tax"]
_PEARSON = "pearson AS (" + _all([f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM lineitem" for a, b in combinations(_LINES, 2)]) + "), both_ AS (SELECT a, b, r FROM pearson UNION ALL SELECT b, a, r FROM pearson)"
_TWO_SETS = f"{_GEO}, {_mined('geo', GEO, 2, 10, 0.5, 'one')}, {_mined('geo', GEO, 2, 60, 0.5, 'two')}"
_SAME_RULE = " AND ".join(f"one.p_{a} IS NOT DISTINCT FROM two.p_{a}" for a in GEO) + " AND one.rhs = two.rhs AND one.rv IS NOT DISTINCT FROM two.rv"


def _plain(name: str) -> str:
    left = ", ".join(f"CASE WHEN p_{a} IS NOT NULL THEN '{a}' END" for a in sorted(GEO))
    return f"SELECT DISTINCT list_filter([{left}], lambda x: x IS NOT NULL) AS lhs, rhs FROM {name}"


def _signature(attributes: list[str]) -> str:
    features = ", ".join(f"'{a}_' || {_t(a)}" for a in attributes)
    least = ", ".join(f"list_min(list_transform([{features}], lambda f: md5('{k}:' || f)))" for k in range(4))
    return f"md5(concat_ws('|', {least}))"


def _quotas(base: str, rows: int) -> str:
    return f"""sized AS (SELECT cluster, count(*) AS size FROM {base} GROUP BY cluster),
ranked AS (SELECT *, coalesce(sum(size) OVER (ORDER BY size, cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_,
                  row_number() OVER (ORDER BY size, cluster) AS rk, count(*) OVER () AS k FROM sized),
shares AS (SELECT *, greatest(ceil(({rows} - before_) / (k - rk + 1)), 0) AS share FROM ranked),
cut AS (SELECT rk, share FROM shares WHERE size > share ORDER BY rk LIMIT 1),
quotas AS (SELECT s.cluster, s.size, CAST(CASE WHEN c.rk IS NULL OR s.rk < c.rk THEN s.size ELSE least(s.size, c.share) END AS BIGINT) AS quota FROM shares s LEFT JOIN cut c ON true)"""


ORACLE_SQL: dict[str, str] = {
    "item_frequency": f"WITH {_GEO} {_items('geo', GEO)}",
    "frequent_items": f"WITH {_PARTS} SELECT * FROM ({_items('parts', PARTS)}) i WHERE n >= 40",
    "column_profile": f"""WITH {_PARTS}, items AS ({_items('parts', PARTS)}), shares AS (SELECT *, n / sum(n) OVER (PARTITION BY attr) AS p FROM items)
SELECT attr, count(*) AS n_distinct, max(n) AS top, count(*) * max(n) AS spread, round(sum(-p * log2(p)), 9) AS entropy, round(sum(-p * ln(p)), 9) AS shannon, round(1 - sum(p * p), 9) AS simpson
FROM shares GROUP BY attr""",
    "gini": """WITH r AS (SELECT l_quantity AS v, sum(l_quantity) OVER (ORDER BY l_quantity, l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(l_quantity) OVER () AS share, sum(l_quantity) OVER () AS total,
  row_number() OVER (ORDER BY l_quantity, l_orderkey, l_linenumber) AS k FROM lineitem)
SELECT round(1 - sum((a.share + b.share) * (a.v - b.v)) / (2 * max(a.total)), 9) AS gini FROM r a JOIN r b ON a.k = b.k + 1""",
    "pair_frequent_values": f"WITH {_PARTS}, sides AS ("
    + _all([f"SELECT unnest(['{a}', '{b}']) AS attr, unnest([count(DISTINCT x), count(DISTINCT y)]) AS score FROM (SELECT {_t(a)} AS x, {_t(b)} AS y FROM parts GROUP BY ALL HAVING count(*) >= 5) v" for a, b in combinations(sorted(PARTS), 2)])
    + ") SELECT attr, CAST(sum(score) AS BIGINT) AS score FROM sides GROUP BY attr HAVING sum(score) > 0",
    "frequent_pairs": f"WITH {_ORDER_GEO}, counted AS (" + _all([f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n_pairs FROM (SELECT 1 FROM og GROUP BY {_t(a)}, {_t(b)} HAVING count(*) >= 50) v" for a, b in combinations(sorted(ORDER_GEO), 2)]) + ") SELECT * FROM counted WHERE n_pairs > 0",
    "columns_with_support": f"WITH {_PARTS} SELECT attr, max(n) AS top FROM ({_items('parts', PARTS)}) i GROUP BY attr HAVING max(n) >= 60",
    "sign_columns": f"WITH {_ORDER_GEO} SELECT attr, count(*) AS n_distinct FROM ({_items('og', ORDER_GEO)}) i GROUP BY attr HAVING count(*) BETWEEN 2 AND 10",
    "factorised": f"WITH {_ORDER_GEO}, firsts AS (SELECT o_orderpriority AS value, min(tid) AS f FROM og GROUP BY 1) SELECT value, row_number() OVER (ORDER BY f) - 1 AS code FROM firsts",
    "partition_count": f"WITH {_GEO} " + _all([f"SELECT '{','.join(x)}' AS attrs, count(*) AS n_classes FROM (SELECT DISTINCT {', '.join(x)} FROM geo) v" for k in (1, 2, 3) for x in combinations(sorted(GEO), k)]),
    "fd_error": f"WITH {_GEO} SELECT lhs, rhs, n_classes, support, support - hits AS error FROM ({_fds('geo', GEO, 2)}) f",
    "fd_confidence": f"WITH {_ORDER_GEO} SELECT lhs, rhs, hits / support AS confidence FROM ({_fds('og', ORDER_GEO, 2)}) f",
    "variable_cfds": f"WITH {_ORDER_GEO} {_shown(f'({_variable("og", ORDER_GEO, 2, 20, 0.3)}) r', ORDER_GEO)}",
    "mixed_tableau": f"WITH {_GEO} {_shown(f'({_variable("geo", GEO, 3, 20, 0)}) r', GEO)}",
    "constant_cfds": f"WITH {_GEO} {_shown(f'({_constant("geo", GEO, 2, 10, 1)}) r', GEO)}",
    "minimal_rules": f"WITH {_GEO}, {_mined('geo', GEO, 2, 10, 0.5)} {_shown('mined', GEO)}",
    "minimal_parts": f"WITH {_PARTS}, {_mined('parts', PARTS, 2, 5, 0.6)} {_shown('mined', PARTS)}",
    "free_sets": f"WITH {_GEO}, sets AS ("
    + _all([f"SELECT {[*x]} AS attrs, count(*) AS n_classes FROM (SELECT DISTINCT {', '.join(x)} FROM geo) v" for k in (1, 2, 3) for x in combinations(sorted(GEO), k)])
    + ") SELECT array_to_string(attrs, ',') AS attrs, n_classes FROM sets s WHERE NOT EXISTS (SELECT 1 FROM sets t WHERE t.n_classes = s.n_classes AND len(t.attrs) = len(s.attrs) - 1 AND list_has_all(s.attrs, t.attrs))",
    "closures": f"WITH {_GEO}, rows_ AS (SELECT [{', '.join(f"'{a}=' || {_t(a)}" for a in sorted(GEO))}] AS held FROM geo), gens AS ("
    + _all([f"SELECT [{', '.join(f'held[{sorted(GEO).index(a) + 1}]' for a in x)}] AS gen, held FROM rows_" for k in (1, 2) for x in combinations(sorted(GEO), k)])
    + """), sup AS (SELECT gen, count(*) AS support FROM gens GROUP BY gen HAVING count(*) >= 10),
ins AS (SELECT gen, item, count(*) AS here FROM (SELECT gen, unnest(held) AS item FROM gens) u GROUP BY gen, item)
SELECT array_to_string(s.gen, ',') AS gen, s.support, (SELECT string_agg(item, ',' ORDER BY item) FROM ins i WHERE i.gen = s.gen AND i.here = s.support) AS closure
FROM sup s WHERE NOT EXISTS (SELECT 1 FROM sup t WHERE len(s.gen) = 2 AND len(t.gen) = 1 AND list_has_all(s.gen, t.gen) AND t.support = s.support)""",
    "sub_table_rules": f"WITH {_GEO}, {_mined('geo', ['n_name', 'r_name'], 1, 10, 0.5, 'a')}, {_mined('geo', ['c_mktsegment', 'r_name', 'n_regionkey'], 2, 10, 0.5, 'b')} "
    + _shown("a", ["n_name", "r_name"], "1 AS set_id, support, hits")
    + " UNION ALL "
    + _shown("b", ["c_mktsegment", "r_name", "n_regionkey"], "2 AS set_id, support, hits"),
    "rule_support_confidence": f"WITH {_MEASURES} SELECT rule_id, support, hits, hits / support AS confidence FROM measures",
    "rule_precision": f"WITH {_MEASURES} SELECT count(*) AS rules, count(*) FILTER (support >= 100) AS supported, count(*) FILTER (support >= 100 AND hits / support >= 0.3) AS valid, count(*) FILTER (support >= 100 AND hits / support >= 0.3) / count(*) FILTER (support >= 100) AS precision FROM measures",
    "constant_violations": f"WITH {_ORDER_GEO}, m AS ({_matched(_CONSTANT)}) SELECT rule_id, tid FROM m WHERE rhs <> rv",
    "fd_violations_multi": f"WITH {_ORDER_GEO}, m AS ({_matched(_VARIABLE)}) SELECT rule_id, tid FROM m QUALIFY min(rhs) OVER (PARTITION BY rule_id, key) <> max(rhs) OVER (PARTITION BY rule_id, key)",
    "fd_violations_mode": f"""WITH {_ORDER_GEO}, m AS ({_matched(_VARIABLE)}), best AS (SELECT rule_id, key, rhs FROM (SELECT rule_id, key, rhs, count(*) AS n FROM m GROUP BY ALL) c QUALIFY row_number() OVER (PARTITION BY rule_id, key ORDER BY n DESC, rhs) = 1)
SELECT m.rule_id, tid FROM m JOIN best b ON m.rule_id = b.rule_id AND m.key = b.key WHERE m.rhs <> b.rhs""",
    "fd_violations_first": f"WITH {_ORDER_GEO}, m AS ({_matched(_VARIABLE)}) SELECT rule_id, tid FROM m QUALIFY rhs <> first_value(rhs) OVER (PARTITION BY rule_id, key ORDER BY tid)",
    "running_violations": f"WITH {_GEO} SELECT tid, count(*) OVER w AS earlier FROM geo WINDOW w AS (PARTITION BY r_name, c_mktsegment ORDER BY tid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) QUALIFY min(n_name) OVER w <> n_name OR max(n_name) OVER w <> n_name",
    "supplemented_sample": f"WITH {_ORDER_GEO}, m AS ({_matched(_CONSTANT)}), s AS (SELECT * FROM og ORDER BY md5(CAST(tid AS VARCHAR)), tid LIMIT 100) SELECT * FROM s UNION ALL SELECT * FROM og WHERE tid IN (SELECT tid FROM m WHERE rhs <> rv) AND tid NOT IN (SELECT tid FROM s)",
    "expanded_rules": f"WITH {_ORDER_GEO}, m AS ({_matched(_VARIABLE)}) SELECT DISTINCT rule_id, array_to_string(key, ',') AS key, rhs FROM m",
    "rule_intersect": f"WITH {_TWO_SETS} {_shown('(SELECT one.* FROM one WHERE EXISTS (SELECT 1 FROM two WHERE ' + _SAME_RULE + ')) s', GEO, 'true AS x').replace(', true AS x', '')}",
    "rule_subsumption": f"WITH {_GEO}, {_mined('geo', GEO, 2, 10, 0.5, 'one')}, two AS ({_constant('geo', GEO, 2, 60, 0.9)}), a AS (SELECT *, {_rule(GEO)} AS txt FROM one), b AS (SELECT *, {_rule(GEO)} AS txt FROM two) SELECT a.txt AS a, b.txt AS b, b.lhs_size - a.lhs_size AS distance FROM a JOIN b ON a.rhs = b.rhs AND a.rv IS NOT DISTINCT FROM b.rv AND "
    + " AND ".join(f"(a.p_{c} IS NULL OR (a.p_{c} = '_' AND b.p_{c} IS NOT NULL) OR a.p_{c} = b.p_{c})" for c in GEO),
    "embedded_fd_match": f"WITH {_TWO_SETS}, a AS ({_plain('one')}), b AS ({_plain('two')}) SELECT array_to_string(a.lhs, ',') AS lhs_a, a.rhs AS rhs_attr, array_to_string(b.lhs, ',') AS lhs_b, CASE WHEN a.lhs = b.lhs THEN 'equal' ELSE 'subset' END AS relation FROM a JOIN b ON a.rhs = b.rhs AND list_has_all(b.lhs, a.lhs)",
    "rule_scores": f"WITH {_TWO_SETS}, n AS (SELECT (SELECT count(*) FROM one) AS n_found, (SELECT count(*) FROM two) AS n_truth, (SELECT count(*) FROM one WHERE EXISTS (SELECT 1 FROM two WHERE {_SAME_RULE})) AS n_same) SELECT *, n_same / n_found AS precision, n_same / n_truth AS recall FROM n",
    "constant_rule_texts": f"WITH {_GEO}, c AS ({_constant('geo', GEO, 2, 60, 1)}), m AS ({_minimal('c', GEO)}) SELECT '[' || concat_ws(', ', "
    + ", ".join(f"CASE WHEN p_{a} IS NOT NULL THEN '{a}' END" for a in sorted(GEO))
    + ") || '] => ' || rhs || ', (' || concat_ws(', ', "
    + ", ".join(f"p_{a}" for a in sorted(GEO))
    + f") || ' || ' || rv || ')' AS rule_id, {_rule(GEO)} AS rule FROM m",
    "max_sets": f"WITH {_BITS}, {_brands('s')}, {_coded('c', 's')}, m AS (SELECT * FROM c WHERE len(attrs) > 1) SELECT array_to_string(attrs, ',') AS attrs FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE len(b.attrs) > len(a.attrs) AND a.code & b.code = a.code)",
    "uncovered_sets": f"WITH {_UNCOVERED} SELECT array_to_string(attrs, ',') AS attrs FROM missed",
    "recall_report": f"WITH {_UNCOVERED} SELECT attr, n_truth, coalesce(n, 0) AS n_uncovered FROM (SELECT attr, count(*) AS n_truth FROM (SELECT unnest(attrs) AS attr FROM t) u GROUP BY attr) e LEFT JOIN (SELECT attr, count(*) AS n FROM (SELECT unnest(attrs) AS attr FROM missed) v GROUP BY attr) g USING (attr)",
    "attribute_counts": f"WITH {_brands('s')} SELECT attr, count(*) AS n FROM (SELECT unnest(attrs) AS attr FROM s) u GROUP BY attr",
    "row_sentence_of_parts": f"WITH {_PARTS} SELECT tid, concat_ws(' ', {', '.join(map(_t, PARTS))}) AS sentence FROM parts",
    "weighted_row_sentence": "SELECT p_partkey AS tid, concat_ws(' ', p_brand, p_brand, p_type) AS sentence FROM part",
    "sub_table": r"SELECT l_orderkey, l_linenumber, regexp_replace(printf('%.2f', l_discount), '\.?0+$', '') AS l_discount, regexp_replace(printf('%.2f', l_quantity), '\.?0+$', '') AS l_quantity FROM lineitem",
    "bag_of_words": r"WITH w AS (SELECT item_id AS tid, lower(regexp_replace(unnest(regexp_split_to_array(trim(text), '\s+')), '^[[:punct:]]+|[[:punct:]]+$', '', 'g')) AS word FROM benchmark) SELECT tid, word, count(*) AS n FROM w WHERE word <> '' GROUP BY tid, word",
    "minhash_sample": f"WITH {_ORDER_GEO}, b AS (SELECT tid, {_signature(ORDER_GEO)} AS bucket FROM og), r AS (SELECT tid, bucket, count(*) OVER (PARTITION BY bucket) AS size, CAST(row_number() OVER (PARTITION BY bucket ORDER BY md5(CAST(tid AS VARCHAR)), tid) AS INTEGER) AS round FROM b) SELECT tid, round FROM r ORDER BY round, size, bucket, tid LIMIT 500",
    "cluster_quota": f"WITH members AS (SELECT p_name AS cluster FROM part), {_quotas('members', 700)} SELECT cluster, size, quota FROM quotas",
    "cluster_quota_sample": f"WITH members AS (SELECT p_partkey AS tid, CAST(p_size AS VARCHAR) AS cluster FROM part), {_quotas('members', 300)} SELECT tid, cluster FROM (SELECT tid, m.cluster, quota, row_number() OVER (PARTITION BY m.cluster ORDER BY md5(CAST(tid AS VARCHAR)), tid) AS n FROM members m JOIN quotas q ON m.cluster = q.cluster) x WHERE n <= quota",
    "simple_sample": f"WITH {_ORDER_GEO} SELECT * FROM og ORDER BY md5(CAST(tid AS VARCHAR)), tid LIMIT 250",
    "pearson_pairs": f"WITH {_PEARSON} SELECT a, b, round(r, 9) AS r FROM pearson",
    "mean_correlation": f"WITH {_PEARSON} SELECT a AS attr, round((sum(r) + 1) / (count(*) + 1), 9) AS mean_r FROM both_ GROUP BY a",
    "topk_correlated": f"WITH {_PEARSON} SELECT a AS attr, b AS other, round(r, 9) AS r, CAST(row_number() OVER (PARTITION BY a ORDER BY abs(r) DESC, b) AS INTEGER) AS rank FROM both_ QUALIFY rank <= 2",
    "semantic_search": f"WITH {_search(_COSINE, 10)} SELECT query_id, corpus_id, round(score, 6) AS score, rank FROM found",
    "dot_search": f"WITH {_search(_DOT, 5)} SELECT query_id, corpus_id, round(score, 6) AS score, rank FROM found",
    "pair_mining": f"WITH met AS (SELECT q.vec_id AS a, c.vec_id AS b, q.embedding::DOUBLE[] AS u, c.embedding::DOUBLE[] AS v FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id), scores AS (SELECT a, b, {_COSINE} AS score FROM met QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 10) SELECT least(a, b) AS a, greatest(a, b) AS b, round(max(score), 6) AS score FROM scores GROUP BY 1, 2 ORDER BY max(scores.score) DESC, 1, 2 LIMIT 100",
    "similarity_histogram": f"WITH {_search(_COSINE, 50)} SELECT CAST(floor(round(score, 6) / 0.02) AS BIGINT) AS bin, count(*) AS n FROM found GROUP BY 1",
    "similarity_histogram_all_rows": f"WITH met AS (SELECT q.embedding::DOUBLE[] AS u, c.embedding::DOUBLE[] AS v FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0) SELECT CAST(floor(round({_COSINE}, 6) / 0.02) AS BIGINT) AS bin, count(*) AS n FROM met GROUP BY 1",
    "vector_functions": f"""WITH {_PAIRS}, d AS (SELECT *, list_sum(list_transform(list_zip(u, v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d2 FROM pairs)
SELECT id, round({_COSINE}, 6) AS cosine, round({_DOT}, 6) AS dot, round(sqrt(d2), 6) AS euclidean, round(list_sum(list_transform(list_zip(u, v), lambda p: abs(p[1] - p[2]))), 6) AS manhattan, round(exp(-0.15 * d2), 6) AS kernel, round(u[1] / sqrt(list_sum(list_transform(u, lambda x: x * x))), 6) AS first FROM d""",
    "binary_best_f1": f"WITH {_CURVE} SELECT round(2 * hit / (n + pos), 9) AS f1, round(hit / n, 9) AS precision, round(hit / pos, 9) AS recall, round(threshold, 9) AS threshold FROM cuts WHERE hit > 0 ORDER BY 2 * hit / (n + pos) DESC, cuts.threshold DESC LIMIT 1",
    "binary_best_accuracy": f"WITH {_CURVE} SELECT round((hit + total - n - pos + hit) / total, 9) AS accuracy, round(threshold, 9) AS threshold FROM cuts ORDER BY (hit + total - n - pos + hit) / total DESC, cuts.threshold DESC LIMIT 1",
    "average_precision": f"WITH {_CURVE} SELECT round(sum(hit / n * ones) / sum(ones), 9) AS ap FROM curve JOIN dealt USING (score)",
    "ir_metrics": f"""WITH {_search(_COSINE, 1000000)}, res AS (SELECT query_id, corpus_id, rank - 1 AS rank FROM found WHERE query_id <> corpus_id AND rank BETWEEN 2 AND 11),
rel AS (SELECT q.vec_id AS query_id, c.vec_id AS corpus_id FROM embeddings q JOIN embeddings c ON q.label = c.label AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
sizes AS (SELECT query_id, count(*) AS nr FROM rel GROUP BY query_id),
hits AS (SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth FROM res JOIN rel USING (query_id, corpus_id)),
per AS (SELECT query_id, nr, coalesce(h, 0) AS h, f, coalesce(dcg, 0) AS dcg, coalesce(pr, 0) AS pr, list_sum(list_transform(range(1, least(nr, 10) + 1), lambda i: 1 / log2(i + 1))) AS ideal
        FROM sizes LEFT JOIN (SELECT query_id, count(*) AS h, min(rank) AS f, sum(1 / log2(rank + 1)) AS dcg, sum(nth / rank) AS pr FROM hits GROUP BY query_id) x USING (query_id))
SELECT count(*) AS queries, round(avg(CASE WHEN h > 0 THEN 1.0::DOUBLE ELSE 0.0 END), 9) AS accuracy, round(avg(h / 10), 9) AS precision, round(avg(h / nr), 9) AS recall, round(avg(coalesce(1 / f, 0)), 9) AS mrr, round(avg(dcg / ideal), 9) AS ndcg, round(avg(pr / least(nr, 10)), 9) AS map FROM per""",
    "rerank_metrics": f"""WITH {_search(_COSINE, 20)}, s AS (SELECT query_id, corpus_id, round(score, 6) AS score, CAST(q.label = c.label AS INTEGER) AS hit FROM found JOIN embeddings q ON q.vec_id = query_id JOIN embeddings c ON c.vec_id = corpus_id),
r AS (SELECT *, row_number() OVER w AS rk, sum(hit) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nth FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, corpus_id)),
p AS (SELECT query_id, sum(hit) AS ones, count(*) AS n, min(rk) FILTER (hit = 1) AS f, sum(nth / rk) FILTER (hit = 1) AS pr FROM r GROUP BY query_id HAVING sum(hit) > 0 AND sum(hit) < count(*))
SELECT count(*) AS queries, round(avg(pr / ones), 9) AS map, round(avg(CASE WHEN f <= 10 THEN 1 / f ELSE 0 END), 9) AS mrr FROM p""",
    "score_correlations": f"""WITH {_PAIRS}, s AS (SELECT round({_COSINE}, 6) AS x, label - other_label AS y FROM pairs),
r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM s)
SELECT round(corr(x, y), 9) AS pearson, round(corr(rx, ry), 9) AS spearman FROM r""",
    "triplet_accuracy": """WITH t AS (SELECT a.embedding::DOUBLE[] AS a, p.embedding::DOUBLE[] AS p, n.embedding::DOUBLE[] AS n FROM embeddings a JOIN embeddings p ON p.vec_id = a.vec_id + 1 JOIN embeddings n ON n.vec_id = a.vec_id + 2)
SELECT avg(CAST(list_cosine_similarity(a, p) > list_cosine_similarity(a, n) AS INTEGER)) AS cosine, avg(CAST(list_distance(a, p) < list_distance(a, n) AS INTEGER)) AS euclidean,
 avg(CAST(list_sum(list_transform(list_zip(a, p), lambda x: abs(x[1] - x[2]))) < list_sum(list_transform(list_zip(a, n), lambda x: abs(x[1] - x[2]))) AS INTEGER)) AS manhattan FROM t""",
    "translation_accuracy": f"""WITH met AS (SELECT q.vec_id AS s, c.vec_id - 1 AS t, q.embedding::DOUBLE[] AS u, c.embedding::DOUBLE[] AS v FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0 AND c.vec_id % 100 = 1),
scores AS (SELECT s, t, round({_COSINE}, 6) AS score FROM met),
f AS (SELECT avg(CAST(s = t AS INTEGER)) AS forward FROM (SELECT s, t FROM scores QUALIFY row_number() OVER (PARTITION BY s ORDER BY score DESC, t) = 1) x),
b AS (SELECT avg(CAST(s = t AS INTEGER)) AS backward FROM (SELECT s, t FROM scores QUALIFY row_number() OVER (PARTITION BY t ORDER BY score DESC, s) = 1) x)
SELECT forward, backward, (forward + backward) / 2 AS accuracy FROM f, b""",
    "translation_accuracy_all_rows": f"""WITH met AS (SELECT q.vec_id AS q, c.vec_id AS c, q.embedding::DOUBLE[] AS u, c.embedding::DOUBLE[] AS v FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 IN (0, 1)),
best AS (SELECT q, c FROM (SELECT q, c, round({_COSINE}, 6) AS score FROM met) x QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, c) = 1)
SELECT *, (forward + backward) / 2 AS accuracy FROM (SELECT avg(CAST(c = q + 1 AS INTEGER)) FILTER (q % 100 = 0) AS forward, avg(CAST(c = q - 1 AS INTEGER)) FILTER (q % 100 = 1) AS backward FROM best) y""",
    "label_accuracy": "SELECT avg(CAST(list_position(embedding[1:10], list_max(embedding[1:10])) - 1 = label AS INTEGER)) AS accuracy FROM embeddings",
    "vector_mse": f"WITH {_PAIRS} SELECT round(100 * sum(list_sum(list_transform(list_zip(u, v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) / sum(len(u)), 6) AS mse FROM pairs",
    "cluster_means": "WITH e AS (SELECT label AS cluster, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS k FROM embeddings) SELECT cluster, CAST(k AS INTEGER) AS \"at\", round(avg(x), 6) AS x FROM e GROUP BY 1, 2",
    # components of core points by walking all edges; border points take the smallest cluster near them
    "dbscan_clusters": """
WITH RECURSIVE points AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
near AS (SELECT a.id AS a, b.id AS b FROM points a JOIN points b ON a.id <> b.id AND list_distance(a.v, b.v) <= 1.13),
core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) + 1 >= 3),
inner_edges AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach(id, other) AS (SELECT id, id FROM core UNION SELECT r.id, e.b FROM reach r JOIN inner_edges e ON r.other = e.a),
parts AS (SELECT id, min(other) AS cluster FROM reach GROUP BY id),
border AS (SELECT n.b AS id, min(p.cluster) AS cluster FROM near n JOIN parts p ON n.a = p.id WHERE n.b NOT IN (SELECT id FROM core) GROUP BY n.b)
SELECT id, cluster FROM points LEFT JOIN (SELECT * FROM parts UNION ALL SELECT * FROM border) USING (id)""",
}


ORACLE_SQL["cosine_dbscan"] = (
    ORACLE_SQL["dbscan_clusters"].replace("list_distance(a.v, b.v) <= 1.13", "list_cosine_similarity(a.v, b.v) >= 0.4").replace("SELECT id, cluster FROM points", "SELECT id, coalesce(cluster, -1) AS cluster FROM points")
)
# one group at a time, in order: its rows that no earlier one took, if there are enough
_COMMUNITIES = """
WITH RECURSIVE points AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
near AS (SELECT a.id AS a, b.id AS b FROM points a JOIN points b ON a.id = b.id OR list_cosine_similarity(a.v, b.v) >= 0.3),
grouped AS (SELECT a, list(b) AS members, count(*) AS size FROM near GROUP BY a HAVING count(*) >= 5),
ordered AS (SELECT *, row_number() OVER (ORDER BY size DESC, a) AS k FROM grouped),
walk(k, community, fresh, taken) AS (
  SELECT 0::BIGINT, NULL::BIGINT, []::BIGINT[], []::BIGINT[]
  UNION ALL
  SELECT o.k, o.a, CASE WHEN len(fresh_) >= 5 THEN fresh_ ELSE [] END, CASE WHEN len(fresh_) >= 5 THEN list_concat(taken, fresh_) ELSE taken END
  FROM (SELECT o.k, o.a, w.taken, list_filter(o.members, lambda x: NOT list_contains(w.taken, x)) AS fresh_ FROM walk w JOIN ordered o ON o.k = w.k + 1) o)
"""
ORACLE_SQL["vector_communities"] = _COMMUNITIES + "SELECT community, unnest(fresh) AS id FROM walk"
ORACLE_SQL["community_centres"] = _COMMUNITIES + ", said AS (SELECT community, unnest(fresh) AS id FROM walk) SELECT community AS cluster, arg_min(id, md5('0|' || id)) AS id FROM said GROUP BY 1"

_WIDE = f"wide AS (SELECT {', '.join(WIDE)} FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
_WIDE_SETS = _all([f"SELECT {[*x]} AS attrs, count(*) AS n_classes FROM (SELECT DISTINCT {', '.join(x)} FROM wide) v" for k in (1, 2) for x in combinations(sorted(WIDE), k)])
_WIDE_LEFT = ", ".join(f"CASE WHEN p_{a} IS NOT NULL THEN '{a}' END" for a in sorted(WIDE))
ORACLE_SQL["mine_wide"] = f"WITH {_WIDE}, {_mined('wide', WIDE, 3, 20, 0.9)} {_shown('mined', WIDE)}"
ORACLE_SQL["free_lhs_rules"] = f"""WITH {_WIDE}, {_mined('wide', WIDE, 2, 20, 0.3)}, sets AS ({_WIDE_SETS}),
tied AS (SELECT s.attrs FROM sets s JOIN sets t ON t.n_classes = s.n_classes AND len(t.attrs) = len(s.attrs) - 1 AND list_has_all(s.attrs, t.attrs))
{_shown('mined', WIDE)} WHERE list_filter([{_WIDE_LEFT}], lambda x: x IS NOT NULL) NOT IN (SELECT attrs FROM tied)"""

ORACLE_SQL["distinct_text_batches"] = """
WITH d AS (SELECT doc_id AS id, md5('0|' || coalesce(text, '')) AS of_, md5('0|' || doc_id) AS turn FROM documents),
m AS (SELECT CAST(greatest(ceil(sum(n) / 32), max(n)) AS BIGINT) AS batches FROM (SELECT count(*) AS n FROM d GROUP BY of_) c)
SELECT id, (row_number() OVER (ORDER BY of_, turn, id) - 1) % batches AS batch FROM d, m"""
ORACLE_SQL["label_batches"] = """
WITH d AS (SELECT doc_id AS id, CAST(2 * quality + toxic AS INTEGER) AS label FROM labels),
r AS (SELECT id, label, (row_number() OVER (PARTITION BY label ORDER BY md5('0|' || id), id) - 1) // 4 AS part, count(*) OVER (PARTITION BY label) // 4 AS parts FROM d WHERE label IS NOT NULL),
g AS (SELECT label, part, (row_number() OVER (ORDER BY md5('0|' || label || '|' || part), label, part) - 1) // 4 AS batch FROM (SELECT DISTINCT label, part FROM r WHERE part < parts) x)
SELECT id, label, batch FROM r LEFT JOIN g USING (label, part) UNION ALL SELECT id, label, NULL FROM d WHERE label IS NULL"""
ORACLE_SQL["run_job"] = f"SELECT 1 AS file, set_id, rule, support, hits FROM ({ORACLE_SQL['sub_table_rules']}) found"
ORACLE_SQL["sampled_columns"] = f"WITH {_PARTS} SELECT tid, {', '.join(_t(a) + ' AS ' + a for a in PARTS[:2])} FROM parts ORDER BY tid LIMIT 1000"

_DBSCAN = ORACLE_SQL["dbscan_clusters"][: ORACLE_SQL["dbscan_clusters"].rindex("SELECT id, cluster FROM points")]


def _lloyd(k: int) -> str:
    mean = f"m{k} AS (SELECT cluster, list(x ORDER BY place) AS c FROM (SELECT cluster, place, avg(x) AS x FROM a{k} JOIN each USING (id) GROUP BY 1, 2) y GROUP BY 1)"
    return f"{mean}, a{k + 1} AS (SELECT id, cluster FROM (SELECT p.id, m.cluster, list_distance(p.v, m.c) AS d FROM points p, m{k} m) z QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, cluster) = 1)"


ORACLE_SQL["dbscan_k_means"] = f"""{_DBSCAN}, each AS (SELECT id, unnest(v) AS x, unnest(range(0, len(v))) AS place FROM points),
labelled AS (SELECT id, coalesce(cluster, -1) AS cluster FROM points LEFT JOIN (SELECT * FROM parts UNION ALL SELECT * FROM border) b USING (id)),
a0 AS (SELECT id, CAST(dense_rank() OVER (ORDER BY cluster) - 1 AS INTEGER) AS cluster FROM labelled), {_lloyd(0)}, {_lloyd(1)}, {_lloyd(2)}
SELECT id, cluster FROM a3"""
ORACLE_SQL["cluster_groups"] = "SELECT label AS cluster, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY vec_id) AS ids FROM embeddings GROUP BY label"
ORACLE_SQL["pooled_vectors"] = """WITH e AS (SELECT vec_id // 100 AS text, vec_id AS id, CAST(vec_id % 3 <> 2 AS INTEGER) AS m, row_number() OVER (PARTITION BY vec_id // 100 ORDER BY vec_id) AS k, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
stops AS (SELECT text, coalesce(min(k) FILTER (m = 0), 1) AS z FROM e GROUP BY text),
x AS (SELECT text, id, m, k, greatest(z - 1, 1) AS stop, unnest(v) AS x, unnest(range(0, len(v))) AS place FROM e JOIN stops USING (text)),
p AS (SELECT text, place, arg_min(x, k) AS f, max(CASE WHEN m = 0 THEN -1e9 ELSE x END) AS mx, sum(x * m) AS s, sum(m) AS n, sum(x * m * k) AS ws, sum(m * k) AS wn, max(x * m) FILTER (k = stop) AS l, avg(x) AS a FROM x GROUP BY text, place)
SELECT text, CAST(place AS INTEGER) AS "at", round(f, 6) + 0 AS first, round(mx, 6) + 0 AS max, round(s / greatest(n, 1e-9), 6) + 0 AS mean, round(s / sqrt(greatest(n, 1e-9)), 6) + 0 AS mean_sqrt_length, round(ws / greatest(wn, 1e-9), 6) + 0 AS weighted_mean, round(l, 6) + 0 AS last, round(a / sqrt(sum(a * a) OVER (PARTITION BY text)), 6) + 0 AS chunks FROM p"""

_CUT = """cut AS (SELECT score, n, rgt, hit, total, coalesce(lead(score) OVER w, score) AS nxt FROM (SELECT *, row_number() OVER w AS n, sum(hit) OVER (w ROWS UNBOUNDED PRECEDING) AS rgt FROM judged WINDOW w AS (ORDER BY score DESC, a, b)) j, total WINDOW w AS (ORDER BY n)),
best AS (SELECT 2 * rgt / (n + total) AS f1, rgt / n AS precision, rgt / total AS recall, (score + nxt) / 2 AS threshold FROM cut WHERE hit = 1 ORDER BY f1 DESC, n LIMIT 1)
SELECT pairs, round(coalesce(ap, 0), 9) AS average_precision, round(coalesce(f1, 0), 9) AS f1, round(coalesce(precision, 0), 9) AS precision, round(coalesce(recall, 0), 9) AS recall, round(coalesce(threshold, 0), 9) AS threshold
FROM (SELECT count(*) AS pairs, sum(rgt / n) FILTER (hit = 1) / max(total) AS ap FROM cut) q LEFT JOIN best ON true"""
ORACLE_SQL["paraphrase_metrics"] = f"""WITH pairs AS ({ORACLE_SQL["pair_mining"]}), known AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 AND a.label = b.label),
total AS (SELECT count(*) AS total FROM known), judged AS (SELECT a, b, score, CAST((a, b) IN (SELECT (a, b) FROM known) AS INTEGER) AS hit FROM pairs), {_CUT}"""
ORACLE_SQL["paraphrase_metrics_closed"] = f"""WITH RECURSIVE pairs AS MATERIALIZED ({ORACLE_SQL["pair_mining"]}), known AS (SELECT a, b FROM pairs WHERE (a + b) % 3 = 0 UNION SELECT b, a FROM pairs WHERE (a + b) % 3 = 0),
reach(id, other) AS (SELECT a, a FROM known UNION SELECT r.id, k.b FROM reach r JOIN known k ON r.other = k.a), joined AS (SELECT DISTINCT id, other FROM reach WHERE id < other),
total AS (SELECT count(*) AS total FROM joined), judged AS (SELECT a, b, score, CAST((a, b) IN (SELECT (id, other) FROM joined) AS INTEGER) AS hit FROM pairs), {_CUT}"""


def _tokens(base: str, a: str, whole: bool) -> str:
    shown = "CAST(code AS VARCHAR)" if whole else f"CASE WHEN (SELECT count(DISTINCT {a}) FROM {base}) < 10 THEN CAST(code AS VARCHAR) ELSE trim({a}) END"
    codes = f"(SELECT {a}, row_number() OVER (ORDER BY min(tid)) - 1 AS code FROM {base} GROUP BY {a}) c"
    return f"SELECT '{a}' AS attr, tid, '{a}_' || {shown} AS token FROM {base} JOIN {codes} USING ({a})"


_WHOLE = {"n_regionkey", "p_size"}
ORACLE_SQL["column_tokens"] = f"WITH {_PARTS} " + _all([_tokens("parts", a, a in _WHOLE) for a in PARTS])
ORACLE_SQL["column_sentences"] = f"WITH {_GEO}, t AS (" + _all([_tokens("geo", a, a in _WHOLE) for a in GEO]) + ") SELECT attr, string_agg(token, ' ' ORDER BY tid) AS sentence FROM t GROUP BY attr"
ORACLE_SQL["value_codes"] = f"WITH {_PARTS} SELECT attr, value, CAST(row_number() OVER (PARTITION BY attr ORDER BY value) AS INTEGER) AS code FROM ({_items('parts', PARTS)}) i"
ORACLE_SQL["row_differences"] = "SELECT o_orderkey AS tid, CASE WHEN o_orderkey % 11 = 0 THEN 'first' ELSE 'both' END AS side FROM orders WHERE o_orderkey % 11 = 0 OR (o_orderkey % 7 = 0 AND o_orderpriority IS NOT NULL)"


def _attrs_of(rules: str, name: str) -> str:
    return f"{name} AS (SELECT DISTINCT list_sort(list_append(lhs, rhs)) AS attrs FROM ({_plain(rules)}) p)"


_LETTERS = "list_aggregate(list_transform(attrs, lambda a: CASE a " + " ".join(f"WHEN '{a}' THEN '{x}'" for a, x in zip(GEO, "abcd", strict=True)) + " END), 'string_agg', '')"
ORACLE_SQL["set_distances"] = f"WITH {_TWO_SETS}, {_attrs_of('one', 's')}, d AS (SELECT {_LETTERS} AS letters, array_to_string(attrs, ',') AS attrs FROM s) SELECT a.attrs, CAST(sum(levenshtein(a.letters, b.letters)) AS BIGINT) AS total FROM d a, d b GROUP BY a.attrs"


def _top_sets(k: int) -> str:
    return f"SELECT DISTINCT list_sort(list_append(list(b), a)) AS attrs FROM (SELECT a, b FROM both_ QUALIFY row_number() OVER (PARTITION BY a ORDER BY abs(r) DESC, b) <= {k}) n GROUP BY a"


ORACLE_SQL["top_sets"] = f"WITH {_PEARSON} SELECT array_to_string(attrs, ',') AS attrs FROM ({_top_sets(2)}) s"
ORACLE_SQL["cross_information"] = f"""WITH {_PEARSON}, c AS ({_top_sets(1)}), r AS ({_top_sets(2)}),
m AS (SELECT c.attrs AS s, r.attrs AS p, list_filter(r.attrs, lambda x: list_contains(c.attrs, x)) AS shared, list_filter(r.attrs, lambda x: NOT list_contains(c.attrs, x)) AS rest FROM c, r),
subs AS (SELECT shared, list_filter(rest, lambda x, i: (bits >> (i - 1)) % 2 = 1) AS more FROM (SELECT shared, rest, unnest(range(0, CAST(2 ** len(rest) AS BIGINT))) AS bits FROM m WHERE len(p) >= len(s)) b)
SELECT array_to_string(p, ',') AS attrs FROM m WHERE len(p) < len(s) UNION SELECT array_to_string(list_sort(list_concat(shared, more)), ',') FROM subs WHERE len(shared) + len(more) = 2"""


def _lasso(moments: str, alpha: float, k: int) -> str:
    """Sets of a lasso for each of the four columns, from one row m of covariances v_ij: weights improved in turn, in rounds."""
    n = range(len(_LINES))
    at = lambda i, j: f"v_{min(i, j)}{max(i, j)}"
    out = [moments]
    for t in n:
        inside = "r"
        others = [i for i in n if i != t]
        for j in others:
            left = f"({at(t, j)} - " + " - ".join(f"w{i} * {at(i, j)}" for i in others if i != j) + ")"
            inside = f"(SELECT * REPLACE (sign({left}) * greatest(abs({left}) - {alpha}, 0) / {at(j, j)} AS w{j}) FROM {inside})"
        step = inside.replace("FROM r)", "FROM r, m WHERE round_ < 400)")
        out.append(f"r AS (SELECT 0 AS round_, {', '.join(f'0.0::DOUBLE AS w{i}' for i in others)} UNION ALL SELECT round_ + 1, {', '.join(f'w{i}' for i in others)} FROM {step} s)".replace("r AS", f"r{t} AS", 1).replace("FROM r, m", f"FROM r{t}, m"))
        each = _all([f"SELECT '{_LINES[i]}' AS a, abs(w{i}) AS w FROM r{t} WHERE round_ = 400" for i in others])
        out.append(f"t{t} AS (SELECT concat_ws(',', (SELECT string_agg(a, ',' ORDER BY w DESC, a) FROM (SELECT * FROM ({each}) e WHERE w > 0 ORDER BY w DESC, a LIMIT {k - 1}) f), '{_LINES[t]}') AS attrs)")
    return "WITH RECURSIVE " + ", ".join(out) + " " + _all([f"SELECT attrs FROM t{t}" for t in n])


_UPPER = [(i, j) for i in range(len(_LINES)) for j in range(i, len(_LINES))]
_COVARIANCES = "m AS (SELECT " + ", ".join(f"covar_pop({_LINES[i]}, {_LINES[j]}) AS v_{i}{j}" for i, j in _UPPER) + " FROM lineitem WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _LINES) + ")"
_KERNEL = f"k AS ({_all(['SELECT ' + ', '.join(f'exp(-0.15 * (2 - 2 * corr({a}, {b}))) AS k{j}' for j, b in enumerate(_LINES)) + ' FROM lineitem' for a in _LINES])}), m AS (SELECT " + ", ".join(f"covar_pop(k{i}, k{j}) AS v_{i}{j}" for i, j in _UPPER) + " FROM k)"
ORACLE_SQL["lasso_sets"] = _lasso(_COVARIANCES, 0.01, 3)
ORACLE_SQL["kernel_lasso_sets"] = _lasso(_KERNEL, 0.0002, 3)


ORACLE_SQL["schema_statistics"] = f"WITH {_ORDER_GEO} " + _all([f"SELECT '{a}' AS attr, count(DISTINCT {a}) AS n_distinct, count(DISTINCT {a}) BETWEEN 2 AND 10 AS sign, {len(ORDER_GEO) // 2 + 1} AS largest FROM og" for a in ORDER_GEO])


def _ranked(name: str, of: str) -> str:
    return f"{name} AS (SELECT p_brand AS item, count(*) AS value, row_number() OVER (ORDER BY count(*) DESC, p_brand) - 1 AS rank FROM {of} GROUP BY p_brand)"


_ORDERED = "lineitem JOIN part ON l_partkey = p_partkey"
ORACLE_SQL["gap_index"] = f"WITH {_ranked('r', _ORDERED)}, g AS (SELECT rank, value, lead(value) OVER (ORDER BY rank) AS next_ FROM r) SELECT coalesce(min(rank) FILTER (value - next_ > 0.025 * value), count(*)) AS index FROM g"
ORACLE_SQL["rank_displacement"] = f"WITH {_ranked('f', _ORDERED)}, {_ranked('e', 'part')} SELECT CAST(sum(CASE WHEN e.item IS NULL THEN 11 ELSE abs(f.rank - e.rank) END) AS BIGINT) AS displacement FROM f LEFT JOIN (SELECT * FROM e WHERE rank < 15) e ON f.item = e.item WHERE f.rank < 10"
_SCORES = {"cosine": _COSINE, "dot": _DOT, "euclidean": "-list_distance(u, v)", "manhattan": "-list_sum(list_transform(list_zip(u, v), lambda p: abs(p[1] - p[2])))"}
ORACLE_SQL["similarity_correlations"] = f"WITH {_PAIRS}, s AS (" + _all([f"SELECT '{k}' AS measure, round({c}, 6) AS x, label - other_label AS y FROM pairs" for k, c in _SCORES.items()]) + """),
r AS (SELECT measure, x, y, rank() OVER (PARTITION BY measure ORDER BY x) + (count(*) OVER (PARTITION BY measure, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY measure ORDER BY y) + (count(*) OVER (PARTITION BY measure, y) - 1) / 2 AS ry FROM s)
SELECT measure, round(corr(x, y), 9) AS pearson, round(corr(rx, ry), 9) AS spearman FROM r GROUP BY measure"""
ORACLE_SQL["deletion_noise"] = r"""WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\t\n\x0B\f\r ]+'), lambda w: w <> '') AS words FROM documents),
d AS (SELECT doc_id, text, list_transform(words, lambda w, i: {'h': md5('0|' || doc_id || '|' || i), 'i': i, 'w': w}) AS drawn FROM w),
k AS (SELECT *, list_filter(drawn, lambda d: d.h[1:8] >= '99999999') AS kept FROM d),
t AS (SELECT doc_id, CASE WHEN len(drawn) = 0 THEN text WHEN len(kept) = 0 THEN list_sort(drawn)[-1].w ELSE array_to_string(list_transform(kept, lambda d: d.w), ' ') END AS text FROM k)
SELECT doc_id AS id, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS digest FROM t"""
ORACLE_SQL["density_order"] = """WITH p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
near AS (SELECT a.id, list_distance(a.v, b.v) AS d FROM p a JOIN p b ON a.id <> b.id WHERE list_distance(a.v, b.v) <= 1.2)
SELECT id, round(d, 6) AS core_distance FROM near QUALIFY row_number() OVER (PARTITION BY id ORDER BY d) = 3"""
