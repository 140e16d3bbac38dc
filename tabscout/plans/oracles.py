"""The same results in plain SQL (DuckDB dialect), written independently of the
Spark code: windows, cross joins and exact quantiles where Spark avoids them."""

from __future__ import annotations

from tabscout.operators.fleet import PLANS, TOOL_FACTS
from tabscout.operators.leakage import SUSPICIOUS_NAMES
from tabscout.operators.profile import ID_NAMES, TEMPORAL_NAMES
from tabscout.operators.report import ADVICE, RECOMMENDATIONS, STATUS_ADVICE
from tabscout.plans.queries import PROFILED
from tabscout.plans.workloads import EVENT_FINDINGS, EVENT_TOOLS, LINE_FEATURES, ORDER_FEATURES
from tabscout.schema import TOOLS

LA = f"la AS (SELECT {LINE_FEATURES} FROM lineitem)"
OA = f"oa AS (SELECT {ORDER_FEATURES} FROM orders)"
RA = """ra AS (
  SELECT n_name, c_mktsegment, c_name, r_name FROM customer
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

LA_FEATURES = (
    "leak leak_lin const_col near_const miss skewed l_quantity l_extendedprice l_discount l_tax l_linenumber"
).split()
OA_FEATURES = "o_orderkey shortcut custkey prio mon".split()


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def r(expression: str, digits: int = 6) -> str:
    return f"(round({expression}, {digits}) + 0.0)"


def union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def long_form(source: str, features, keep: str = "", cast: str = "DOUBLE") -> str:
    keep = keep + ", " if keep else ""
    return union(f"SELECT {keep}'{f}' AS feature, CAST({f} AS {cast}) AS value FROM {source}" for f in features)


def nan_null(expression: str) -> str:
    return f"(CASE WHEN isnan({expression}) OR isinf({expression}) THEN NULL ELSE {expression} END)"


ORACLES: dict[str, str] = {}

# --- leakage ---

ORACLES["leak_corr"] = f"WITH {LA}\n" + union(
    f"SELECT '{f}' AS feature, count({f}) AS n, {r(nan_null(f'corr({f}, target)'))} AS correlation FROM la"
    for f in LA_FEATURES
)
ORACLES["leak_linear"] = f"WITH {LA}\n" + union(
    f"""SELECT '{f}' AS feature, {r(f'regr_r2(target, {f})') if f != 'const_col' else 'max(CAST(NULL AS DOUBLE))'} AS r2,
    {r(f'regr_slope(target, {f})') if f != 'const_col' else 'max(CAST(NULL AS DOUBLE))'} AS coefficient,
    {r(f'regr_intercept(target, {f})') if f != 'const_col' else 'max(CAST(NULL AS DOUBLE))'} AS intercept FROM la"""
    for f in LA_FEATURES
)
RA_LONG = long_form("ra", ["n_name", "c_mktsegment", "c_name"], "r_name AS class", "VARCHAR")
RA_JOINT = f"""WITH {RA}, l AS ({RA_LONG}),
j AS (SELECT feature, value, class, count(*) AS n FROM l GROUP BY ALL),
p AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS total,
  sum(n) OVER (PARTITION BY feature, value) AS nx, sum(n) OVER (PARTITION BY feature, class) AS ny FROM j),
mi AS (SELECT feature, max(total) AS n,
  greatest(sum(n / total * ln(n * total / (nx * ny))), 0.0) AS mi FROM p GROUP BY feature),
ent AS (SELECT feature, -sum(s * ln(s)) AS h FROM (
  SELECT feature, class, sum(n) / max(total) AS s FROM p GROUP BY feature, class) GROUP BY feature)"""
ORACLES["leak_mutual_info"] = f"""{RA_JOINT}
SELECT feature, CAST(n AS BIGINT) AS n, {r('mi')} AS mutual_information, {r('h')} AS target_entropy,
  {r('mi / h')} AS normalized_mi, {r('mi / (h / ln(2))')} AS normalized_mi_mixed_units
FROM mi JOIN ent USING (feature)"""
ORACLES["leak_perfect_predictor"] = f"""WITH {RA}, l AS ({RA_LONG}),
v AS (SELECT feature, value, count(*) AS n, count(DISTINCT class) AS k FROM l GROUP BY feature, value)
SELECT feature, CAST(sum(n) AS BIGINT) AS n, count(*) AS distinct_values, max(k) AS max_classes_per_value,
  sum(n) >= 10 AND count(*) > 2 AND max(k) = 1 AS perfect FROM v GROUP BY feature"""
LINE_COLUMNS = (
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_linestatus l_shipdate"
).split()
WORDS = "[" + ", ".join(q(w) for w in SUSPICIOUS_NAMES) + "]"
ORACLES["leak_names"] = union(
    f"SELECT '{c}' AS feature, list_filter({WORDS}, lambda w: contains('{c}', w))[1] AS keyword, count({c}) AS filled FROM lineitem"
    for c in LINE_COLUMNS
)
ORACLES["leak_identical"] = f"WITH {LA}\n" + union(
    f"SELECT '{f}' AS feature, bool_and({f} IS NOT DISTINCT FROM target) AS identical FROM la"
    for f in ("leak", "leak_lin", "const_col", "near_const", "l_linenumber")
)
ORACLES["leak_encoded_target"] = f"""WITH v AS (
  SELECT DISTINCT feature, value FROM ({long_form('part', ['p_brand', 'p_name', 'p_type'], cast='VARCHAR')})),
t AS (SELECT DISTINCT CAST(p_size AS VARCHAR) AS target FROM part)
SELECT feature, count(DISTINCT value) AS distinct_values,
  count(DISTINCT CASE WHEN contains(value, target) THEN target END) AS matched_targets
FROM v CROSS JOIN t GROUP BY feature"""
ORACLES["leak_findings"] = f"""WITH {LA}, m AS ({union(
    f"SELECT '{f}' AS feature, {nan_null(f'corr({f}, target)')} AS c FROM la" for f in LA_FEATURES)}),
k AS (SELECT 'leakage_detector' AS tool, feature, c FROM m WHERE c IS NOT NULL)
SELECT tool, CASE WHEN abs(c) > 0.99 THEN 'perfect_correlation' ELSE 'high_correlation' END AS type,
  CASE WHEN abs(c) > 0.99 THEN 'critical' ELSE 'warning' END AS severity, feature FROM k WHERE abs(c) > 0.95
UNION ALL SELECT tool, 'linear_transformation', 'critical', feature FROM k WHERE c * c > 0.999
UNION ALL SELECT 'leakage_detector', 'identical_to_target', 'critical', 'leak'
  FROM la HAVING bool_and(leak IS NOT DISTINCT FROM target)
UNION ALL SELECT 'leakage_detector', 'suspicious_name', 'warning', feature
  FROM m WHERE len(list_filter({WORDS}, lambda w: contains(lower(feature), w))) > 0"""

_LA_COLUMNS = ", ".join((*LA_FEATURES, "target"))
ORACLES["audit_timeline"] = f"""WITH {LA},
lf AS (SELECT count(*) AS n, count(*) FILTER (WHERE severity = 'critical') AS hard FROM ({ORACLES["leak_findings"]})),
rows AS (SELECT count(*) AS n FROM la),
dups AS (SELECT rows.n - (SELECT count(*) FROM (SELECT DISTINCT {_LA_COLUMNS} FROM la)) AS n FROM rows),
steps AS (
  SELECT 0 AS position, 'leakage_detector' AS tool, CASE WHEN n = 0 THEN 'pass' WHEN hard > 0 THEN 'fail' ELSE 'warning' END AS status, n AS findings_count FROM lf
  UNION ALL SELECT 1, 'contamination_detector', CASE WHEN n = 0 THEN 'pass' ELSE 'warning' END, CASE WHEN n = 0 THEN 0 ELSE 1 END FROM dups)
SELECT position::BIGINT AS position, tool, status, findings_count::BIGINT AS findings_count, TRUE AS timed, rows.n AS num_rows,
  {len(LA_FEATURES) + 1}::BIGINT AS num_columns, 'target' AS target_column FROM steps, rows"""

# --- contamination ---

ORACLES["dup_rows"] = f"""SELECT 'documents' AS source, count(*) AS total,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS count,
  {r('(count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents))) * 100.0 / count(*)')} AS percentage
FROM documents
UNION ALL SELECT 'lineitem', count(*),
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)),
  {r('(count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))) * 100.0 / count(*)')}
FROM lineitem"""
ORACLES["contam_exact"] = f"""WITH train AS (SELECT DISTINCT text, lang FROM documents WHERE doc_id % 10 < 7),
test AS (SELECT text, lang FROM documents WHERE doc_id % 10 >= 7)
SELECT count(*) AS total, count(*) FILTER (WHERE found) AS count,
  {r('count(*) FILTER (WHERE found) * 100.0 / count(*)')} AS percentage
FROM (SELECT EXISTS (SELECT 1 FROM train WHERE train.text IS NOT DISTINCT FROM test.text
  AND train.lang IS NOT DISTINCT FROM test.lang) AS found FROM test)"""
ORACLES["contam_hash"] = f"""WITH h AS (SELECT doc_id,
  md5(concat_ws('|', coalesce(text, 'nan'), coalesce(lang, 'nan'))) AS digest FROM documents),
test AS (SELECT digest IN (SELECT digest FROM h WHERE doc_id % 10 < 7) AS found FROM h WHERE doc_id % 10 >= 7)
SELECT count(*) AS total, count(*) FILTER (WHERE found) AS count,
  {r('count(*) FILTER (WHERE found) * 100.0 / count(*)')} AS percentage FROM test"""
ORACLES["contam_keys"] = f"""WITH test AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_linenumber > 5),
common AS (SELECT k FROM test INTERSECT SELECT l_orderkey FROM lineitem WHERE l_linenumber <= 5)
SELECT (SELECT count(*) FROM test) AS total, (SELECT count(*) FROM common) AS count,
  {r('(SELECT count(*) FROM common) * 100.0 / (SELECT count(*) FROM test)')} AS percentage"""
ORACLES["contam_cosine"] = f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
train AS (SELECT v FROM v WHERE vec_id % 5 <> 0),
test AS (SELECT vec_id, v FROM v WHERE vec_id % 5 = 0 UNION ALL
  SELECT vec_id, list_prepend(v[1] + 0.01, v[2:]) FROM v WHERE vec_id % 5 = 1),
best AS (SELECT test.vec_id, max(list_cosine_similarity(test.v, train.v)) AS s FROM test CROSS JOIN train GROUP BY test.vec_id)
SELECT count(*) AS total, count(*) FILTER (WHERE s >= 0.95) AS count,
  {r('count(*) FILTER (WHERE s >= 0.95) * 100.0 / count(*)')} AS percentage, CAST(0.95 AS DOUBLE) AS threshold FROM best"""
_PARTS = ("p_size", "p_retailprice", "p_partkey")
ORACLES["contam_cosine_rows"] = f"""WITH s AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in _PARTS)}
  FROM part WHERE p_partkey % 10 < 7),
z AS (SELECT p_partkey, [{', '.join(f'(CAST({c} AS DOUBLE) - m_{c}) / s_{c}' for c in _PARTS)}] AS v FROM part, s),
best AS (SELECT a.p_partkey, max(list_cosine_similarity(a.v, b.v)) AS s FROM z a CROSS JOIN z b
  WHERE a.p_partkey % 10 >= 7 AND b.p_partkey % 10 < 7 GROUP BY a.p_partkey)
SELECT count(*) AS total, count(*) FILTER (WHERE s >= 0.9999) AS count,
  {r('count(*) FILTER (WHERE s >= 0.9999) * 100.0 / count(*)')} AS percentage, CAST(0.9999 AS DOUBLE) AS threshold FROM best"""
ORACLES["split_sizes"] = """SELECT count(*) FILTER (WHERE doc_id % 10 < 7) AS train_size,
  count(*) FILTER (WHERE doc_id % 10 >= 7) AS test_size FROM documents"""

# --- bias ---

_BALANCED = (("labels", "toxic"), ("events", "event_type"), ("lineitem", "l_returnflag"))
ORACLES["class_balance"] = union(
    f"""SELECT '{t}' AS source, CAST({y} AS VARCHAR) AS class, count(*) AS n,
    {r(f'count(*) * 100.0 / (SELECT count(*) FROM {t})')} AS percentage FROM {t} WHERE {y} IS NOT NULL GROUP BY {y}"""
    for t, y in _BALANCED
)
ORACLES["class_ratio"] = union(
    f"""SELECT '{t}' AS source, CAST(sum(n) AS BIGINT) AS rows, count(*) AS classes, max(n) AS majority_n, min(n) AS minority_n,
    arg_min(c, (-n, c)) AS majority, arg_min(c, (n, c)) AS minority, {r('max(n) / CAST(min(n) AS DOUBLE)')} AS ratio
    FROM (SELECT CAST({y} AS VARCHAR) AS c, count(*) AS n FROM {t} GROUP BY {y})"""
    for t, y in _BALANCED
)
ORACLES["kruskal"] = f"""WITH {LA}, raw AS (
  {long_form('la', LA_FEATURES, "'lineitem' AS source, target3 AS class")}
  UNION ALL SELECT 'events', event_type, 'value', value FROM events),
held AS (SELECT * FROM raw WHERE value IS NOT NULL),
ranked AS (SELECT *, rank() OVER (PARTITION BY source, feature ORDER BY value)
  + (count(*) OVER (PARTITION BY source, feature, value) - 1) / 2.0 AS mid,
  count(*) OVER (PARTITION BY source, feature, value) AS tie FROM held),
g AS (SELECT source, feature, class, count(*) AS n, sum(mid) AS rs,
  sum(CAST(tie AS DOUBLE) * tie - 1) AS ts FROM ranked GROUP BY ALL),
f AS (SELECT source, feature, CAST(sum(n) AS DOUBLE) AS n, count(*) AS groups, sum(rs * rs / n) AS spread, sum(ts) AS ties
  FROM g GROUP BY source, feature),
h AS (SELECT *, CASE WHEN n * n * n - n - ties > 0 THEN
  (12.0 / (n * (n + 1)) * spread - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) END AS s FROM f)
SELECT source, feature, CAST(n AS BIGINT) AS n, groups, {r('s')} AS statistic,
  {r('CASE groups WHEN 3 THEN exp(-s / 2) WHEN 5 THEN exp(-s / 2) * (1 + s / 2) END')} AS p_value,
  {r('(s - groups + 1) / (n - groups)')} AS effect_size FROM h"""
_LA_ALL = LA_FEATURES
ORACLES["missing_by_class"] = f"WITH {LA}\n" + union(
    f"SELECT '{f}' AS feature, target3 AS class, count(*) AS n, count(*) FILTER (WHERE {f} IS NULL) AS missing FROM la GROUP BY target3"
    for f in _LA_ALL
)


def _chi2(label: str, column: str, p_value: str) -> str:
    gap = "abs(o - e)"
    cell = f"({gap} - least(0.5, {gap}))" if column == "target" else gap
    return f"""SELECT '{label}' AS label, feature, CAST(sum(o) AS BIGINT) AS rows,
  CAST(sum(o) FILTER (WHERE gone) AS BIGINT) AS missing,
  {r('sum(o) FILTER (WHERE gone) * 100.0 / sum(o)')} AS missing_rate,
  {r('coalesce(max(rate) - min(rate), 0)')} AS difference,
  CAST(CASE WHEN min(e) > 0 THEN count(DISTINCT class) - 1 ELSE 0 END AS BIGINT) AS dof,
  {r(f'CASE WHEN min(e) > 0 THEN sum({cell} * {cell} / nullif(e, 0)) ELSE 0 END')} AS chi2, {p_value} AS p_value
FROM (SELECT feature, class, gone, o, o * 100.0 / cn AS r0, CASE WHEN gone THEN o * 100.0 / cn END AS rate,
    rn * CAST(cn AS DOUBLE) / total AS e FROM (
  SELECT *, sum(o) OVER (PARTITION BY feature, class) AS cn, sum(o) OVER (PARTITION BY feature, gone) AS rn,
    sum(o) OVER (PARTITION BY feature) AS total FROM (
  {union(f"SELECT '{f}' AS feature, {column} AS class, x.gone, count(*) FILTER (WHERE ({f} IS NULL) = x.gone) AS o "
         f"FROM la CROSS JOIN (VALUES (true), (false)) x(gone) GROUP BY {column}, x.gone" for f in LA_FEATURES)})))
GROUP BY feature"""


_GAP1 = "CASE WHEN min(e) > 0 THEN sum((abs(o - e) - least(0.5, abs(o - e))) * (abs(o - e) - least(0.5, abs(o - e))) / nullif(e, 0)) END"
# Tail of one degree of freedom: one minus a series of positive terms, x ** (n + 1/2) over odd factorials.
_TAIL1 = """CASE WHEN p_value IS NULL OR p_value <= 0 THEN 1.0 WHEN p_value > 200 THEN 0.0
  ELSE 1 - sqrt(2 / pi()) * list_sum(list_transform(range(0, 400), lambda n:
    exp((n + 0.5) * ln(p_value) - lgamma(2 * n + 2) + n * ln(2) + lgamma(n + 1) - p_value / 2))) END"""
_GAP3 = "CASE WHEN min(e) > 0 THEN exp(-sum((o - e) * (o - e) / nullif(e, 0)) / 2) ELSE 1.0 END"
_SIZED = union(
    f"SELECT '{name}' AS dataset, sum(n) AS rows, count(*) AS classes, max(n) AS high, min(n) AS low FROM (SELECT count(*) AS n FROM {source} GROUP BY {label})"
    for name, source, label in (
        ("labels by toxic", "labels", "toxic"),
        ("toxic labels by quality", "labels WHERE toxic = 1", "quality"),
        ("events", "events", "event_type"),
        ("one event", "events WHERE event_id = 0", "event_type"),
    )
)
ORACLES["sample_size_findings"] = f"""WITH s AS ({_SIZED}), g AS (SELECT *, high / low::DOUBLE AS ratio FROM s)
SELECT dataset, 'single_class' AS type, 'critical' AS severity, round(classes::DOUBLE, 6) AS metric FROM g WHERE classes < 2
UNION ALL SELECT dataset, CASE WHEN ratio > 100 THEN 'severe' WHEN ratio > 10 THEN 'moderate' ELSE 'mild' END || '_imbalance',
  CASE WHEN ratio > 100 THEN 'critical' WHEN ratio > 10 THEN 'warning' ELSE 'info' END, round(ratio, 6) FROM g WHERE classes >= 2 AND ratio > 3
UNION ALL SELECT dataset, 'small_dataset', 'warning', rows::DOUBLE FROM g WHERE rows < 100
UNION ALL SELECT dataset, 'small_class_size', CASE WHEN low < 10 THEN 'critical' ELSE 'warning' END, low::DOUBLE FROM g WHERE low < 30"""
ORACLES["missing_chi2"] = (
    f"WITH {LA}\n"
    + _chi2("target3", "target3", r(_GAP3))
    + "\nUNION ALL\n"
    + f"SELECT * REPLACE ({r(_TAIL1)} AS p_value) FROM ({_chi2('target', 'target', _GAP1)})"
)
ORACLES["skewness"] = f"WITH {LA}\n" + union(
    f"""SELECT '{f}' AS feature, count({f}) AS n, {r(nan_null(f'skewness({f})'), 4)} AS skewness,
    {r(f'avg({f})', 4)} AS mean, {r(f'median({f})', 4)} AS median FROM {t}"""
    for t, f in [("la", f) for f in LA_FEATURES] + [("events", "value")]
)

# --- samplers ---

_SC_NUM = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax".split()
ORACLES["sample_columns"] = f"""WITH s AS ({union(
    f"SELECT '{c}' AS feature, 'numeric' AS kind, var_samp(CAST({c} AS DOUBLE)) AS score, {i} AS place FROM lineitem"
    for i, c in enumerate(_SC_NUM))}
UNION ALL SELECT 'l_linestatus', 'other', CAST(count(DISTINCT l_linestatus) AS DOUBLE), 8 FROM lineitem
UNION ALL SELECT 'l_shipdate', 'other', CAST(count(DISTINCT l_shipdate) AS DOUBLE), 9 FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, place) AS position FROM s)
SELECT feature, kind, {r('score', 2)} AS score, position,
  position <= CASE kind WHEN 'numeric' THEN 4 ELSE 1 END AS kept FROM k"""
_MD5 = "md5(concat_ws('|', '42', CAST({key} AS VARCHAR)))"
_EV = "event_id, user_id, event_type, value"
ORACLES["sample_stratified"] = f"""WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1),
s AS (SELECT event_type, n * 1000.0 / sum(n) OVER () AS share FROM c),
w AS (SELECT event_type, floor(share) AS w, row_number() OVER (ORDER BY share - floor(share) DESC, event_type) AS o,
  1000 - sum(floor(share)) OVER () AS spare FROM s),
k AS (SELECT e.*, row_number() OVER (PARTITION BY e.event_type ORDER BY {_MD5.format(key='event_id')}) AS rn FROM events e)
SELECT {', '.join('k.' + x.strip() for x in _EV.split(','))} FROM k JOIN w USING (event_type)
WHERE rn <= w + CASE WHEN o <= spare THEN 1 ELSE 0 END"""
ORACLES["sample_random"] = f"SELECT {_EV} FROM events ORDER BY {_MD5.format(key='event_id')} LIMIT 1000"
_OA_NUM = ["o_orderkey", "target", "shortcut", "custkey", "prio", "mon"]
ORACLES["sample_quantile"] = f"""WITH {OA}, e AS (SELECT {', '.join(
    f"list_distinct(quantile_cont(CAST({c} AS DOUBLE), [0.2, 0.4, 0.6, 0.8, 1.0])) AS q_{c}, min({c}) AS lo_{c}" for c in _OA_NUM)} FROM oa),
k AS (SELECT oa.*, {' + '.join(
    f"len(list_filter(q_{c}, lambda x: x < {c} AND x > lo_{c}))" for c in _OA_NUM)} AS code FROM oa, e),
n AS (SELECT code, count(*) AS n, count(*) OVER () AS codes FROM k GROUP BY code),
rk AS (SELECT k.*, codes, row_number() OVER (PARTITION BY code ORDER BY {_MD5.format(key='o_orderkey')}) AS rn FROM k JOIN n USING (code))
SELECT {', '.join(_OA_NUM)} FROM rk WHERE rn <= greatest(1, floor(1000 / codes))"""
ORACLES["sample_adaptive"] = f"""WITH {OA}, c AS (SELECT target, count(*) AS n FROM oa GROUP BY 1),
s AS (SELECT target, n * 1200.0 / sum(n) OVER () AS share FROM c),
w AS (SELECT target, floor(share) AS w, row_number() OVER (ORDER BY share - floor(share) DESC, target) AS o,
  1200 - sum(floor(share)) OVER () AS spare FROM s),
k AS (SELECT oa.*, row_number() OVER (PARTITION BY target ORDER BY {_MD5.format(key='o_orderkey')}) AS rn FROM oa)
SELECT k.o_orderkey, k.target FROM k JOIN w USING (target) WHERE rn <= w + CASE WHEN o <= spare THEN 1 ELSE 0 END"""

# --- shortcuts ---

ORACLES["single_feature_binned"] = f"""WITH {OA}, l AS ({long_form('oa', OA_FEATURES,
    "CAST(target AS VARCHAR) AS class, CAST(('0x' || substr(" + _MD5.format(key='o_orderkey') + ", 1, 8)) AS BIGINT) % 3 AS fold")}),
e AS (SELECT feature, list_distinct(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edges FROM l GROUP BY feature),
b AS (SELECT feature, fold, class, len(list_filter(edges, lambda x: x < value)) AS bin FROM l JOIN e USING (feature)),
c AS (SELECT feature, fold, bin, class, count(*) AS n FROM b GROUP BY ALL),
t AS (SELECT f.fold, x.feature, x.bin, x.class, x.total - coalesce(c.n, 0) AS seen, coalesce(c.n, 0) AS held
  FROM (SELECT feature, bin, class, sum(n) AS total FROM c GROUP BY ALL) x CROSS JOIN (VALUES (0), (1), (2)) f(fold)
  LEFT JOIN c ON c.feature = x.feature AND c.bin = x.bin AND c.class = x.class AND c.fold = f.fold),
u AS (SELECT feature, fold, arg_min(class, (-s, class)) AS usual FROM (
  SELECT feature, fold, class, sum(seen) AS s FROM t GROUP BY ALL) GROUP BY ALL),
h AS (SELECT t.feature, t.fold, t.bin, CASE WHEN max(seen) > 0 THEN arg_min(held, (-seen, class))
  ELSE sum(CASE WHEN class = usual THEN held ELSE 0 END) END AS hit, sum(held) AS held FROM t JOIN u USING (feature, fold) GROUP BY ALL),
a AS (SELECT feature, avg(s) AS accuracy FROM (SELECT feature, fold, sum(hit) / CAST(sum(held) AS DOUBLE) AS s FROM h GROUP BY ALL) GROUP BY feature),
m AS (SELECT max(n) / CAST(sum(n) AS DOUBLE) AS share, sum(n) AS n FROM (SELECT count(*) AS n FROM oa GROUP BY target))
SELECT feature, CAST(m.n AS BIGINT) AS n, {r('accuracy')} AS accuracy, {r('share')} AS majority_share,
  {r('accuracy - share')} AS lift_over_majority FROM a, m"""
ORACLES["threshold_rules"] = f"""WITH {OA}, l AS ({long_form('oa', OA_FEATURES, 'target')}),
t AS (SELECT feature, unnest([25, 50, 75]) AS percentile, unnest(quantile_cont(value, [0.25, 0.5, 0.75])) AS threshold FROM l GROUP BY feature)
SELECT feature, count(*) AS n, CAST(percentile AS BIGINT) AS percentile, {r('threshold')} AS threshold,
  {r('avg(CASE WHEN (value > threshold) = (target = 1) THEN 1.0 ELSE 0.0 END)')} AS accuracy
FROM l JOIN t USING (feature) GROUP BY feature, percentile, threshold"""
ORACLES["relative_spread"] = f"WITH {LA}\n" + union(
    f"SELECT '{f}' AS feature, count({f}) AS n, {r(f'CASE WHEN avg({f}) = 0 THEN 0 ELSE stddev_samp({f}) / avg({f}) END')} AS coefficient_variation FROM la"
    for f in LA_FEATURES
)
ORACLES["unstable_predictors"] = f"WITH {OA}\n" + f"""SELECT * FROM ({union(
    f"SELECT '{f}' AS feature, 'unstable_predictor' AS type, 'warning' AS severity, {r(f'stddev_samp({f}) / avg({f})')} AS metric FROM oa"
    for f in OA_FEATURES)}) WHERE metric < 0.6 AND feature IN (
  SELECT feature FROM ({ORACLES['single_feature_binned'].replace('WITH ' + OA + ',', 'WITH')}) WHERE accuracy > 0.5)"""

# --- utility ---

ORACLES["value_concentration"] = f"""WITH {LA}, v AS (
  SELECT feature, value, count(*) AS n FROM ({long_form('la', ['target3', *LA_FEATURES], cast='VARCHAR')}) WHERE value IS NOT NULL GROUP BY ALL)
SELECT feature, (SELECT count(*) FROM la) AS rows, count(*) AS distinct_values, max(n) AS top_count,
  {r('max(n) / CAST((SELECT count(*) FROM la) AS DOUBLE)')} AS top_share FROM v WHERE feature <> 'target3' GROUP BY feature"""
ORACLES["cardinality"] = f"WITH {RA}\n" + union(
    f"""SELECT '{c}' AS feature, count(DISTINCT {c}) AS distinct_values, {r(f'count(DISTINCT {c}) / CAST(count(*) AS DOUBLE)')} AS ratio,
    count(DISTINCT {c}) / CAST(count(*) AS DOUBLE) > 0.5 AND count(DISTINCT {c}) > 20 AS high_cardinality,
    count(DISTINCT {c}) / CAST(count(*) AS DOUBLE) > 0.95 AS identifier FROM ra"""
    for c in ("n_name", "c_mktsegment", "c_name")
)
ORACLES["variation"] = f"WITH {LA}\n" + union(
    f"""SELECT '{f}' AS feature, count({f}) AS n, {r(f'avg({f})', 4)} AS mean, {r(f'stddev_samp({f})', 4)} AS std,
    {r(f'CASE WHEN abs(avg({f})) > 1e-10 THEN abs(stddev_samp({f}) / avg({f})) END', 4)} AS coefficient_of_variation FROM la"""
    for f in LA_FEATURES
)
ORACLES["redundant_pairs"] = f"WITH {LA}\n" + union(
    f"""SELECT '{a}' AS feature1, '{b}' AS feature2, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n,
    {r(nan_null(f'corr({a}, {b})')) if 'const_col' not in (a, b) else 'CAST(NULL AS DOUBLE)'} AS correlation FROM la"""
    for i, a in enumerate(LA_FEATURES)
    for b in LA_FEATURES[i + 1 :]
)
ORACLES["low_information"] = f"""WITH {LA}, l0 AS ({long_form('la', LA_FEATURES, 'target3 AS class')}),
l AS (SELECT feature, class, coalesce(value, avg(value) OVER (PARTITION BY feature)) AS value FROM l0),
e AS (SELECT feature, list_distinct(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edges FROM l GROUP BY feature),
j AS (SELECT feature, class, len(list_filter(edges, lambda x: x < value)) AS bin, count(*) AS n FROM l JOIN e USING (feature) GROUP BY ALL),
p AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS total, sum(n) OVER (PARTITION BY feature, bin) AS nx,
  sum(n) OVER (PARTITION BY feature, class) AS ny FROM j),
m AS (SELECT feature, max(total) AS n, greatest(0.0, sum(n / total * ln(n * total / (nx * ny)))
  - (count(DISTINCT bin) - 1) * (count(DISTINCT class) - 1) / (2.0 * max(total))) AS mi FROM p GROUP BY feature)
SELECT feature, CAST(n AS BIGINT) AS n, {r('mi')} AS mutual_information, {r('mi / max(mi) OVER ()')} AS normalized_mi FROM m"""
ORACLES["missing_values"] = (
    f"WITH {LA}, da AS (SELECT doc_id, lang, source, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))\n"
    + union(
        f"""SELECT '{s}' AS source, '{f}' AS feature, count(*) FILTER (WHERE {f} IS NULL) AS missing_count, count(*) AS total_count,
    {r(f'count(*) FILTER (WHERE {f} IS NULL) / CAST(count(*) AS DOUBLE)')} AS missing_rate FROM {t}"""
        for s, t, f in [("lineitem", "la", f) for f in LA_FEATURES]
        + [("documents", "da", f) for f in ("doc_id", "source", "n_chars", "quality", "toxic")]
    )
)
_U_FINDINGS = f"""{LA}, m AS ({union(
    f"SELECT '{f}' AS feature, count(DISTINCT {f}) AS d, abs(stddev_samp({f}) / nullif(avg({f}), 0)) AS cv, "
    f"(SELECT max(n) FROM (SELECT count(*) AS n FROM la WHERE {f} IS NOT NULL GROUP BY {f})) / CAST(count(*) AS DOUBLE) AS top, "
    f"count(*) FILTER (WHERE {f} IS NULL) / CAST(count(*) AS DOUBLE) AS gone FROM la" for f in LA_FEATURES)}),
c AS ({union(
    f"SELECT '{a}, {b}' AS feature, {nan_null(f'corr({a}, {b})')} AS c FROM la"
    for i, a in enumerate(LA_FEATURES) for b in LA_FEATURES[i + 1:] if 'const_col' not in (a, b))}),
u AS (SELECT 'constant_feature' AS type, 'critical' AS severity, feature FROM m WHERE d = 1
UNION ALL SELECT 'near_constant_feature', 'warning', feature FROM m WHERE d > 1 AND top > 0.95
UNION ALL SELECT 'low_variance_numeric', 'warning', feature FROM m WHERE cv < 0.01
UNION ALL SELECT CASE WHEN gone > 0.7 THEN 'excessive_missing' ELSE 'high_missing' END,
  CASE WHEN gone > 0.7 THEN 'critical' ELSE 'warning' END, feature FROM m WHERE gone > 0.4
UNION ALL SELECT 'redundant_features', 'warning', feature FROM c WHERE abs(c) > 0.95)"""
ORACLES["utility_findings"] = f"WITH {_U_FINDINGS} SELECT * FROM u"
ORACLES["recommended_removals"] = f"""WITH {_U_FINDINGS}
SELECT DISTINCT 'lineitem' AS dataset, feature FROM u WHERE severity = 'critical' AND NOT contains(feature, ',')"""

# --- profiles ---

_TYPES = {
    "region": ("r_regionkey", "r_name"),
    "nation": ("n_nationkey", "n_name", "n_regionkey"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
    "lineitem": tuple(LINE_COLUMNS[:8]) + ("l_returnflag", "l_linestatus", "l_shipdate"),
    "events": ("event_id", "ts", "user_id", "event_type", "value", "props"),
    "documents": ("doc_id", "text", "lang", "source", "n_chars"),
    "embeddings": ("vec_id", "embedding", "label"),
    "pages": ("page_id", "url", "html"),
    "benchmark": ("item_id", "text"),
    "labels": ("doc_id", "quality", "toxic"),
    "conversations": ("conv_id", "turn", "role", "text"),
}
_TEXT = set(
    "r_name n_name c_name c_mktsegment s_name p_name p_brand p_type o_orderstatus o_orderpriority l_returnflag l_linestatus "
    "event_type props text lang source url html role".split()
)
_OTHER = {"o_orderdate", "l_shipdate", "ts", "embedding"}


def _profile(table: str, target: str) -> str:
    columns = _TYPES[table]
    numeric = sum(c not in _TEXT and c not in _OTHER for c in columns)
    textual = sum(c in _TEXT for c in columns)

    def named(fragments):
        return str(any(f in c.lower() for c in columns for f in fragments)).lower()

    gaps = " + ".join(f"CAST({c} IS NULL AS INT)" for c in columns)
    return f"""SELECT '{table}' AS dataset, CAST(sum(n) AS BIGINT) AS num_rows, CAST({len(columns) - 1} AS BIGINT) AS num_features,
  count(c) AS num_classes, CASE WHEN count(c) > 1 THEN min(n) FILTER (WHERE c IS NOT NULL) / CAST(max(n) FILTER (WHERE c IS NOT NULL) AS DOUBLE) ELSE 1.0 END AS class_balance_ratio,
  CAST(sum(g) AS DOUBLE) / (sum(n) * {len(columns)}) AS missing_ratio, CAST({numeric / len(columns)!r} AS DOUBLE) AS numeric_ratio,
  CAST({textual / len(columns)!r} AS DOUBLE) AS categorical_ratio, {named(TEMPORAL_NAMES)} AS has_temporal_features,
  {named(ID_NAMES)} AS has_id_features FROM (SELECT {target} AS c, count(*) AS n, sum({gaps}) AS g FROM {table} GROUP BY {target})"""


COMPLEXITY = """least(CAST(1.0 AS DOUBLE), CAST(0 AS DOUBLE) + CASE WHEN num_rows > 100000 THEN 0.1::DOUBLE ELSE 0::DOUBLE END
  + CASE WHEN num_features > 50 THEN 0.15::DOUBLE ELSE 0::DOUBLE END
  + CASE WHEN class_balance_ratio < 0.3::DOUBLE THEN 0.2::DOUBLE WHEN class_balance_ratio < 0.5::DOUBLE THEN 0.1::DOUBLE ELSE 0::DOUBLE END
  + CASE WHEN missing_ratio > 0.2::DOUBLE THEN 0.15::DOUBLE WHEN missing_ratio > 0.1::DOUBLE THEN 0.08::DOUBLE ELSE 0::DOUBLE END
  + CASE WHEN has_temporal_features THEN 0.15::DOUBLE ELSE 0::DOUBLE END
  + CASE WHEN has_id_features THEN 0.1::DOUBLE ELSE 0::DOUBLE END
  + CASE WHEN num_classes > 10 THEN 0.1::DOUBLE ELSE 0::DOUBLE END)"""
DATASET_TYPE = """concat_ws('_', CASE WHEN num_rows < 5000 THEN 'small' ELSE 'large' END,
  CASE WHEN class_balance_ratio < 0.3::DOUBLE THEN 'imbalanced' ELSE 'balanced' END,
  CASE WHEN complexity_score < 0.3::DOUBLE THEN 'simple' ELSE 'complex' END)"""
PROFILE_KEY = """concat_ws('_', CASE WHEN num_rows < 10000 THEN 'small' ELSE 'large' END,
  CASE WHEN num_features < 20 THEN 'few' ELSE 'many' END,
  CASE WHEN class_balance_ratio > 0.5::DOUBLE THEN 'balanced' ELSE 'imbalanced' END)"""
ORACLES["profiles"] = f"""WITH p AS ({union(_profile(t, y) for t, y in PROFILED.items())}),
k AS (SELECT *, {COMPLEXITY} AS complexity_score FROM p)
SELECT * REPLACE ({', '.join(f'{r(c)} AS {c}' for c in ('class_balance_ratio', 'missing_ratio', 'numeric_ratio', 'categorical_ratio', 'complexity_score'))}),
  {DATASET_TYPE} AS dataset_type, {PROFILE_KEY} AS profile_key FROM k"""

# --- findings derived from events ---


def _kind() -> str:
    out = "CASE event_type"
    for event, levels in EVENT_FINDINGS.items():
        inner = " ".join(f"WHEN value > {limit} THEN '{name}'" for limit, name in levels if limit is not None)
        out += f" WHEN '{event}' THEN CASE {inner} ELSE '{levels[-1][1]}' END"
    return out + " END"


TOOL_CASE = "CASE event_type " + " ".join(f"WHEN '{e}' THEN '{t}'" for e, t in EVENT_TOOLS.items()) + " END"
EF = f"""ef0 AS (SELECT concat_ws('/', CAST(user_id AS VARCHAR), CAST(CAST(ts AS DATE) AS VARCHAR)) AS dataset, {TOOL_CASE} AS tool,
  {_kind()} AS type, CASE WHEN value > 100 THEN 'critical' WHEN value > 20 THEN 'warning' ELSE 'info' END AS severity,
  'f' || CAST(event_id % 7 AS VARCHAR) AS feature, event_type, value FROM events),
ef AS (SELECT *, CASE type WHEN 'train_test_contamination' THEN (value - 100) / 10 WHEN 'small_class_size' THEN floor(value - 60)
  WHEN 'perfect_correlation' THEN value / 45 ELSE value END AS metric FROM ef0),
ex AS (SELECT dataset, tool, position FROM (SELECT DISTINCT dataset FROM ef),
  (VALUES {', '.join(f"('{t}', {i})" for i, t in enumerate(TOOLS))}) v(tool, position))"""
_COUNTS = """count(*) FILTER (WHERE severity = 'critical') AS critical_count,
  count(*) FILTER (WHERE severity = 'warning') AS warning_count, count(*) FILTER (WHERE severity = 'info') AS info_count"""
ORACLES["severity_rollup"] = f"WITH {EF} SELECT dataset, tool, count(*) AS total_findings, {_COUNTS} FROM ef GROUP BY ROLLUP (dataset, tool)"
ORACLES["critical_leaks"] = f"""WITH {EF} SELECT dataset, tool, type, severity, feature, {r('metric')} AS metric
FROM ef WHERE tool = 'leakage_detector' AND severity = 'critical'"""
_STATUS = f"""st AS (SELECT ex.dataset, ex.tool, CAST(ex.position AS BIGINT) AS position, count(ef.type) AS findings_count, {_COUNTS}
  FROM ex LEFT JOIN ef USING (dataset, tool) GROUP BY ALL)"""
ORACLES["single_check_status"] = f"""WITH {EF}, {_STATUS} SELECT *, CASE WHEN findings_count = 0 THEN 'pass' WHEN critical_count > 0 THEN 'fail'
  WHEN warning_count > 0 THEN 'warning' ELSE 'info' END AS status FROM st"""
ORACLES["split_sources"] = """WITH s AS (SELECT CASE WHEN o_orderkey % 10 < 7 THEN 'train' ELSE 'test' END AS side, o_orderstatus, o_totalprice FROM orders),
b AS (SELECT * FROM s UNION ALL SELECT 'both', o_orderstatus, o_totalprice FROM s)
SELECT side, o_orderstatus, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS price FROM b GROUP BY ALL"""
ORACLES["findings_export"] = f"""WITH {EF} SELECT tool, type, severity, feature, count(*) AS n FROM ef GROUP BY ALL"""
ORACLES["tool_status"] = f"""WITH {EF}, {_STATUS} SELECT *, CASE WHEN findings_count = 0 THEN 'pass'
  WHEN critical_count > 0 THEN 'fail' ELSE 'warning' END AS status FROM st"""


def _has(text: str) -> str:
    return f"count(*) FILTER (WHERE contains(type, '{text}'))"


def _advice() -> str:
    rules = {
        "perfect": "leak AND perfect > 0",
        "overlap_low": "contam AND overlap <= 1",
        "near_only": "contam AND near > 0 AND overlap IS NULL",
        "severe": "bias AND severe > 0",
        "missing": "bias AND gone > 0",
        "dominance": "spur AND dominance > 0",
        "low_info": "util AND low_info > 0 AND low_info = n",
    }
    items = [f"CASE WHEN {rules[k]} THEN {q(text)} END" for k in rules for text in ADVICE[k]]
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


CRITIC = f"""{EF}, cf0 AS (SELECT dataset, tool, count(*) AS n,
  count(*) FILTER (WHERE type = 'perfect_correlation' AND metric > 0.99) AS perfect,
  count(*) FILTER (WHERE type = 'suspicious_name') AS names, count(*) FILTER (WHERE type = 'identical_to_target') AS identical,
  max(metric) FILTER (WHERE type = 'train_test_contamination') AS overlap, count(*) FILTER (WHERE type = 'near_duplicates') AS near,
  count(*) FILTER (WHERE type = 'severe_imbalance') AS severe, min(metric) FILTER (WHERE type = 'small_class_size') AS smallest,
  {_has('missing')} AS gone, {_has('dominance')} AS dominance, {_has('threshold')} AS threshold, {_has('constant')} AS constant,
  {_has('low_information')} AS low_info FROM ef GROUP BY dataset, tool),
cf AS (SELECT ex.dataset, ex.tool, ex.position, cf0.* EXCLUDE (dataset, tool), {', '.join(
    f"ex.tool = '{t}' AS {a}" for t, a in zip(TOOLS, ('leak', 'contam', 'bias', 'spur', 'util')))}
  FROM ex LEFT JOIN cf0 ON ex.dataset = cf0.dataset AND ex.tool = cf0.tool),
cr AS (SELECT dataset, tool, position, CAST(CASE WHEN n IS NULL THEN 1.0
    WHEN leak AND identical > 0 THEN 1.0 WHEN leak AND names = n THEN 0.7
    WHEN contam AND overlap > 10 THEN 0.9 WHEN contam AND overlap > 1 THEN 0.7 WHEN contam AND overlap IS NOT NULL THEN 0.5
    WHEN contam AND near > 0 THEN 0.7
    WHEN bias AND smallest < 10 THEN 0.9 WHEN bias AND smallest IS NOT NULL THEN 0.7 WHEN bias AND severe > 0 THEN 0.9
    WHEN spur AND dominance > 0 THEN 0.7
    WHEN util AND low_info = n THEN 0.7 WHEN util AND constant > 0 THEN 0.9 ELSE 1.0 END AS DOUBLE) AS confidence,
  coalesce(spur AND dominance > 0, false) AS needs_recheck,
  CAST(coalesce(CAST(leak AND perfect > 0 AS INT) + CAST(leak AND names > 0 AND names = n AS INT) + CAST(leak AND identical > 0 AS INT)
    + CAST(contam AND overlap IS NOT NULL AS INT) + CAST(contam AND near > 0 AND overlap IS NULL AS INT)
    + CAST(bias AND severe > 0 AS INT) + CAST(bias AND smallest IS NOT NULL AS INT) + CAST(spur AND dominance > 0 AS INT)
    + CAST(spur AND threshold > 0 AS INT) + CAST(util AND low_info > 0 AND low_info = n AS INT), 0) AS BIGINT) AS concerns,
  {_advice()} AS recs FROM cf)"""
ORACLES["critic_confidence"] = f"""WITH {CRITIC} SELECT dataset, tool, confidence, needs_recheck, concerns,
  array_to_string(recs, ' / ') AS recommendations FROM cr"""
_ASSESS = """ca AS (SELECT dataset, avg(confidence) AS conf, CAST(sum(concerns) AS BIGINT) AS concerns,
  CAST(len(list_distinct(flatten(list(recs)))) AS BIGINT) AS recommendations,
  coalesce(string_agg(tool, ' / ' ORDER BY position) FILTER (WHERE needs_recheck), '') AS rechecks, count(*) AS critique_count FROM cr GROUP BY dataset)"""
ORACLES["critic_assessment"] = f"""WITH {CRITIC}, {_ASSESS} SELECT dataset, {r('conf')} AS overall_confidence,
  CASE WHEN round(conf, 9) >= 0.9 THEN 'high' WHEN round(conf, 9) >= 0.7 THEN 'medium' ELSE 'low' END AS reliability,
  concerns, recommendations, rechecks AS tools_needing_recheck, critique_count FROM ca"""
READY = f"""{CRITIC}, sm AS (SELECT ex.dataset, count(DISTINCT ex.tool) AS tools_executed, count(ef.type) AS total_findings, {_COUNTS}
  FROM ex LEFT JOIN ef USING (dataset, tool) GROUP BY ex.dataset),
sc AS (SELECT sm.*, critical_count > 0 AS has_critical_blockers, conf, greatest(15, least(100, 100
  - CASE WHEN critical_count = 0 THEN 0 WHEN critical_count = 1 THEN 12 WHEN critical_count = 2 THEN 22 ELSE 22 + (critical_count - 2) * 7 END
  - CASE WHEN warning_count <= 3 THEN warning_count * 3 WHEN warning_count <= 6 THEN 9 + (warning_count - 3) * 2 ELSE 15 + warning_count - 6 END
  - CASE WHEN round(conf, 9) < 0.7 THEN 5 ELSE 0 END)) AS readiness_score
  FROM sm JOIN (SELECT dataset, avg(confidence) AS conf FROM cr GROUP BY dataset) USING (dataset)),
rd AS (SELECT * EXCLUDE (conf), {r('conf')} AS overall_confidence,
  CASE WHEN critical_count >= 3 OR readiness_score < 30 THEN 'NOT READY'
    WHEN critical_count > 0 OR readiness_score < 60 OR warning_count > 5 THEN 'NEEDS ATTENTION'
    WHEN readiness_score >= 80 AND warning_count <= 3 THEN 'READY' ELSE 'NEEDS ATTENTION' END AS verdict FROM sc)"""
ORACLES["readiness"] = f"WITH {READY} SELECT * REPLACE (CAST(readiness_score AS BIGINT) AS readiness_score) FROM rd"
RECS = f"""rs AS (SELECT dataset, unnest(recs) AS recommendation FROM cr
UNION SELECT dataset, {q(RECOMMENDATIONS['leakage'])} FROM ef WHERE tool = 'leakage_detector'
UNION SELECT dataset, {q(RECOMMENDATIONS['imbalance'])} FROM ef WHERE type = 'severe_imbalance'
UNION SELECT dataset, {q(RECOMMENDATIONS['contamination'])} FROM ef WHERE tool = 'contamination_detector')"""
ORACLES["recommendations"] = f"WITH {CRITIC}, {RECS} SELECT dataset, recommendation FROM rs"
ORACLES["audit_reports"] = f"""WITH {READY}, {RECS} SELECT dataset, verdict, CAST(readiness_score AS BIGINT) AS readiness_score, total_findings,
  critical_count AS blockers, warning_count AS warnings, total_findings AS findings,
  (SELECT count(*) FROM rs WHERE rs.dataset = rd.dataset) AS recommendations, tools_executed AS timeline FROM rd"""
ORACLES["adaptive_status"] = f"""WITH {EF}, s AS (SELECT dataset, {_COUNTS},
  bool_or(tool = 'leakage_detector' AND severity = 'critical') AS leak, bool_or(type = 'severe_imbalance') AS severe FROM ef GROUP BY dataset)
SELECT dataset, CASE WHEN critical_count > 0 THEN 'red' WHEN warning_count > 3 THEN 'yellow' ELSE 'green' END AS current_status,
  array_to_string(list_filter([CASE WHEN leak THEN 'data_leakage' END, CASE WHEN severe THEN 'class_imbalance' END], lambda x: x IS NOT NULL), ' / ') AS priority_areas,
  array_to_string(list_filter([CASE WHEN leak THEN {q(STATUS_ADVICE['data_leakage'])} END,
    CASE WHEN severe THEN {q(STATUS_ADVICE['class_imbalance'])} END], lambda x: x IS NOT NULL), ' / ') AS recommendations FROM s"""
ORACLES["severity_distribution"] = f"WITH {EF} SELECT severity, count(*) AS n FROM ef GROUP BY severity"

# --- history derived from events ---

EP = f"""ep0 AS (SELECT user_id AS owner, CAST(CAST(ts AS DATE) AS VARCHAR) AS audit,
  CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) + 1 AS num_rows, count(*) * 7 + 5 AS num_features,
  count(DISTINCT event_type) + 2 AS num_classes,
  CAST(min(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / max(CAST(round(value * 100) AS BIGINT)) AS class_balance_ratio,
  count(*) FILTER (WHERE event_type = 'error') / (4.0::DOUBLE * count(*)) AS missing_ratio,
  bool_or(event_type = 'click') AS has_temporal_features, bool_or(event_type = 'view') AS has_id_features
  FROM events GROUP BY ALL),
ep AS (SELECT *, {COMPLEXITY} AS complexity_score FROM ep0),
es0 AS (SELECT user_id AS owner, CAST(CAST(ts AS DATE) AS VARCHAR) AS audit, {TOOL_CASE} AS tool, min(ts) AS started,
  sum(CAST(round(value * 100) AS BIGINT)) / 10000.0::DOUBLE AS seconds, count(*) FILTER (WHERE value > 20) AS findings,
  count(*) FILTER (WHERE value > 100) AS criticals FROM events GROUP BY ALL),
es AS (SELECT * EXCLUDE (started), row_number() OVER (PARTITION BY owner, audit ORDER BY started, tool) - 1 AS position FROM es0)"""
ORACLES["fleet_types"] = f"""WITH {EP} SELECT owner, audit, {r('complexity_score')} AS complexity_score,
  {DATASET_TYPE} AS dataset_type, {PROFILE_KEY} AS profile_key FROM ep"""
_TOOLS_VALUES = "(VALUES " + ", ".join(
    f"('{n}', {i}, {c}::DOUBLE, {x}::DOUBLE)" for i, (n, c, x) in enumerate(TOOL_FACTS)
) + ") tl(tool, tool_order, cost, critical_rate)"
ORACLES["eligibility"] = f"""WITH {EP} SELECT owner, audit, tool,
  NOT ((tool = 'feature_utility' AND num_classes - 1 <= 3) OR (tool = 'spurious_detector' AND num_rows < 50)) AS eligible
FROM ep, {_TOOLS_VALUES}"""


def _score(effectiveness: str) -> str:
    return f"""greatest(0::DOUBLE, least(1::DOUBLE, CASE tool
  WHEN 'leakage_detector' THEN CASE WHEN has_id_features THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN has_temporal_features THEN 0.3::DOUBLE ELSE 0 END + 0.3::DOUBLE
  WHEN 'bias_detector' THEN CASE WHEN class_balance_ratio < 0.5 THEN 0.5::DOUBLE ELSE 0 END
    + CASE WHEN class_balance_ratio < 0.3 THEN 0.3::DOUBLE ELSE 0 END + missing_ratio * 0.3::DOUBLE + 0.2::DOUBLE
  WHEN 'contamination_detector' THEN CASE WHEN num_rows < 10000 THEN 0.3::DOUBLE ELSE 0 END + 0.4::DOUBLE
  WHEN 'spurious_detector' THEN complexity_score * 0.4::DOUBLE + CASE WHEN num_features > 20 THEN 0.3::DOUBLE ELSE 0 END + 0.2::DOUBLE
  ELSE CASE WHEN num_features > 30 THEN 0.4::DOUBLE WHEN num_features > 15 THEN 0.2::DOUBLE ELSE 0 END + 0.3::DOUBLE END
  + {effectiveness} * 0.3::DOUBLE - cost * 0.1::DOUBLE + critical_rate * 0.2::DOUBLE))"""


SCORED = f"sd AS (SELECT owner, audit, tool, tool_order, {_score('0.5::DOUBLE')} AS score FROM ep, {_TOOLS_VALUES})"
ORACLES["relevance_scores"] = f"WITH {EP}, {SCORED} SELECT owner, audit, tool, {r('score')} AS score FROM sd"
ORACLES["check_plan"] = f"""WITH {EP}, {SCORED} SELECT owner, audit, tool, {r('score')} AS score,
  row_number() OVER (PARTITION BY owner, audit ORDER BY score DESC, tool_order) AS plan_position FROM sd WHERE score >= 0.45"""
SIMILAR = """lp AS (SELECT * FROM ep QUALIFY audit = max(audit) OVER (PARTITION BY owner)),
pp AS (SELECT * FROM ep QUALIFY audit < max(audit) OVER (PARTITION BY owner)),
se AS (SELECT lp.owner, lp.audit, es.tool, avg(least(1::DOUBLE, es.criticals / greatest(1::DOUBLE, es.seconds))) AS effectiveness
  FROM lp JOIN pp ON lp.owner = pp.owner
    AND abs(lp.num_rows - pp.num_rows) / CAST(greatest(lp.num_rows, pp.num_rows) AS DOUBLE) <= 0.5
    AND abs(lp.num_features - pp.num_features) / CAST(greatest(lp.num_features, pp.num_features) AS DOUBLE) <= 0.5
    AND abs(lp.complexity_score - pp.complexity_score) <= 0.3::DOUBLE
  JOIN es ON es.owner = pp.owner AND es.audit = pp.audit GROUP BY ALL)"""
ORACLES["similar_effectiveness"] = f"WITH {EP}, {SIMILAR} SELECT owner, audit, tool, {r('effectiveness')} AS effectiveness FROM se"
ORACLES["audit_outcomes"] = f"""WITH {EP} SELECT owner, audit, count(*) AS tools, {r('sum(seconds)')} AS total_time,
  CAST(sum(criticals) AS BIGINT) AS critical_found, {r('CASE WHEN sum(seconds) > 0 THEN count(*) / sum(seconds) ELSE 0 END')} AS efficiency,
  {r('sum(criticals) / CAST(count(*) AS DOUBLE)')} AS critical_per_tool, {r('count(*) / 5.0')} AS coverage FROM es GROUP BY owner, audit"""
ORACLES["tool_usage"] = f"WITH {EP} SELECT tool, count(*) AS audits FROM es GROUP BY tool"
ORACLES["profile_variety"] = f"""WITH {EP} SELECT owner, count(*) AS audits, count(DISTINCT {PROFILE_KEY}) AS unique_profiles,
  count(DISTINCT {DATASET_TYPE}) AS dataset_types FROM ep GROUP BY owner"""
ORACLES["history_round_trip"] = f"""WITH {EP} SELECT owner, audit, position, tool, {r('seconds')} AS seconds, findings, criticals FROM es"""


def fold(source: str, keys: str, first: bool) -> str:
    """The halving recurrence by recursion over the audit order."""
    start = "value" if first else "value / 2"
    on = " AND ".join(f"o.{k.strip()} = p.{k.strip()}" for k in keys.split(","))
    return f"""o AS (SELECT {keys}, value, row_number() OVER (PARTITION BY {keys} ORDER BY audit) AS i,
  count(*) OVER (PARTITION BY {keys}) AS last FROM {source}),
w AS (SELECT {keys}, i, last, CAST({start} AS DOUBLE) AS e FROM o WHERE i = 1
  UNION ALL SELECT {', '.join('o.' + k.strip() for k in keys.split(','))}, o.i, o.last, (p.e + o.value) / 2 FROM w p JOIN o ON {on} AND o.i = p.i + 1)"""


ORACLES["strategy_effectiveness"] = f"""WITH RECURSIVE {EP},
sv AS (SELECT es.owner, es.audit, tool, {PROFILE_KEY} AS profile_key, criticals / greatest(0.1::DOUBLE, seconds) AS value
  FROM es JOIN ep ON es.owner = ep.owner AND es.audit = ep.audit),
{fold('sv', 'owner, tool, profile_key', True)}
SELECT owner, tool, profile_key, {r('e')} AS effectiveness FROM w WHERE i = last"""
ORACLES["mean_effectiveness"] = ORACLES["strategy_effectiveness"].replace(
    f"SELECT owner, tool, profile_key, {r('e')} AS effectiveness FROM w WHERE i = last",
    f"SELECT owner, tool, {r('avg(e)')} AS effectiveness FROM w WHERE i = last GROUP BY owner, tool",
)
PERF = f"""{EP}, sp AS (SELECT *, sum(seconds) OVER (PARTITION BY owner, audit ORDER BY position) AS spent FROM es),
pf0 AS (SELECT owner, audit, list(tool ORDER BY position) AS tools, min(spent) FILTER (WHERE criticals > 0) AS first_critical,
  sum(seconds) AS total_time, CAST(sum(criticals) AS BIGINT) AS critical_found, avg(CASE WHEN findings = 0 THEN 1.0 ELSE 0.0 END) AS empty_share,
  CASE WHEN sum(seconds) > 0 THEN sum(criticals) / sum(seconds) ELSE 0 END AS efficiency FROM sp GROUP BY owner, audit),
pf AS (SELECT pf0.*, {DATASET_TYPE} AS dataset_type, complexity_score FROM pf0 JOIN ep USING (owner, audit))"""
ORACLES["position_effectiveness"] = f"""WITH RECURSIVE {PERF},
pv AS (SELECT owner, audit, dataset_type, es.tool, CASE WHEN first_critical IS NOT NULL THEN efficiency / (es.position + 1) ELSE 0.5 END AS value
  FROM pf JOIN es USING (owner, audit)),
{fold('pv', 'owner, dataset_type, tool', False)}
SELECT owner, dataset_type, tool, {r('e')} AS effectiveness FROM w WHERE i = last"""
ORACLES["audit_performance"] = f"""WITH {PERF} SELECT owner, audit, array_to_string(tools, '>') AS tool_sequence,
  {r('first_critical')} AS time_to_first_critical, {r('total_time')} AS total_time, critical_found, {r('empty_share')} AS empty_share,
  {r('efficiency')} AS efficiency, len(tools) < 5 AS early_stop, dataset_type FROM pf"""
ORACLES["best_sequences"] = f"""WITH {PERF}, b AS (SELECT dataset_type, array_to_string(tools, '>') AS sequence, avg(efficiency) AS efficiency,
  count(*) AS audits FROM pf GROUP BY ALL HAVING bool_or(critical_found > 0 AND efficiency > 0.1))
SELECT dataset_type, sequence, {r('efficiency')} AS efficiency, audits FROM b
QUALIFY row_number() OVER (PARTITION BY dataset_type ORDER BY round(efficiency, 12) DESC, audits DESC, sequence) = 1"""
_RECENT = """re AS (SELECT owner, audit, row_number() OVER (PARTITION BY owner ORDER BY audit) AS seen,
  avg(empty_share) OVER (PARTITION BY owner ORDER BY audit ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS share FROM pf)"""
ORACLES["recent_empty_share"] = f"WITH {PERF}, {_RECENT} SELECT owner, audit, seen, {r('share')} AS recent_empty_share FROM re"
_TUNED = """mv AS (SELECT owner, seen, CASE WHEN seen < 3 THEN 0 WHEN share > 0.4 THEN 1 WHEN share < 0.1 THEN -1 ELSE 0 END AS m,
  count(*) OVER (PARTITION BY owner) AS audits FROM re),
lv AS (SELECT owner, seen, audits, greatest(-3, least(3, m)) AS s FROM mv WHERE seen = 1
  UNION ALL SELECT mv.owner, mv.seen, mv.audits, greatest(-3, least(3, lv.s + mv.m)) FROM lv JOIN mv ON mv.owner = lv.owner AND mv.seen = lv.seen + 1)"""
ORACLES["threshold_tuning"] = f"""WITH RECURSIVE {PERF}, {_RECENT}, {_TUNED}
SELECT owner, audits, CAST(s AS BIGINT) AS steps, CAST(round(0.45 + s * 0.05, 2) AS DOUBLE) AS skip_threshold FROM lv WHERE seen = audits"""


def patterns(source: str) -> str:
    return f"""l20 AS (SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY owner ORDER BY audit DESC) <= 20),
g20 AS (SELECT owner, count(*) AS n, count(*) FILTER (WHERE complexity_score > 0.4::DOUBLE) AS risky,
  count(*) FILTER (WHERE complexity_score > 0.4::DOUBLE AND tools[1] = 'leakage_detector') AS led,
  count(*) FILTER (WHERE contains(dataset_type, 'imbalanced')) AS uneven,
  count(*) FILTER (WHERE contains(dataset_type, 'imbalanced') AND list_contains(tools[1:2], 'bias_detector')) AS early FROM l20 GROUP BY owner),
pt AS (SELECT owner, 'id_features_leakage_first' AS pattern, 'leakage_detector' AS tool, led / CAST(risky AS DOUBLE) AS confidence, risky AS sample_size
  FROM g20 WHERE n >= 5 AND risky >= 3 AND led / CAST(risky AS DOUBLE) > 0.7
UNION ALL SELECT owner, 'imbalanced_bias_priority', 'bias_detector', early / CAST(uneven AS DOUBLE), uneven
  FROM g20 WHERE n >= 5 AND uneven >= 3 AND early / CAST(uneven AS DOUBLE) > 0.7)"""


ORACLES["mined_patterns"] = f"WITH {PERF}, {patterns('pf')} SELECT owner, pattern, tool, {r('confidence')} AS confidence, sample_size FROM pt"
_BOOSTS = """bo AS (SELECT lp.owner, lp.audit, pt.tool, pattern,
  CASE pattern WHEN 'id_features_leakage_first' THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END * confidence AS boost FROM lp JOIN pt USING (owner)
  WHERE (pattern = 'id_features_leakage_first' AND has_id_features) OR (pattern = 'imbalanced_bias_priority' AND class_balance_ratio < 0.3))"""
ORACLES["learned_boosts"] = f"WITH {PERF}, {SIMILAR}, {patterns('pf')}, {_BOOSTS} SELECT owner, audit, tool, pattern, {r('boost')} AS boost FROM bo"
ORACLES["learned_plan"] = f"""WITH RECURSIVE {PERF}, {SIMILAR}, pq AS (SELECT pf.* FROM pf JOIN pp USING (owner, audit)), {patterns('pq')}, {_BOOSTS},
{_RECENT.replace('FROM pf', 'FROM pq')}, {_TUNED}, tu AS (SELECT owner, round(0.45 + s * 0.05, 2) AS skip FROM lv WHERE seen = audits),
sl AS (SELECT t.owner, t.audit, t.tool, t.tool_order, {_score('coalesce(se.effectiveness, 0.5::DOUBLE)')} + coalesce(bo.boost, 0) AS score, coalesce(tu.skip, 0.45) AS skip
  FROM (SELECT * FROM lp, {_TOOLS_VALUES}) t LEFT JOIN se USING (owner, audit, tool) LEFT JOIN bo USING (owner, audit, tool) LEFT JOIN tu USING (owner))
SELECT owner, audit, tool, {r('score')} AS score, row_number() OVER (PARTITION BY owner, audit ORDER BY score DESC, tool_order) AS plan_position
FROM sl WHERE score >= skip"""
ORACLES["improvement"] = f"""WITH {PERF}, k AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY audit) AS i,
  row_number() OVER (PARTITION BY owner ORDER BY audit DESC) AS j FROM pf),
m AS (SELECT owner, count(*) AS audits, avg(efficiency) FILTER (WHERE i <= 5) AS a, avg(efficiency) FILTER (WHERE j <= 5) AS b FROM k GROUP BY owner)
SELECT owner, audits, {r('a')} AS early_efficiency, {r('b')} AS late_efficiency,
  {r('CASE WHEN audits < 10 OR a = 0 THEN 0 ELSE greatest(-100.0, least(100.0, (b - a) / a * 100)) END')} AS improvement_rate FROM m"""
ORACLES["history_summary"] = f"""WITH {PERF}, k AS (SELECT * FROM pf QUALIFY row_number() OVER (PARTITION BY owner ORDER BY audit DESC) <= 10)
SELECT owner, count(*) AS recent_audits, {r('avg(efficiency)')} AS avg_efficiency_recent, {r('avg(first_critical)')} AS avg_time_to_critical FROM k GROUP BY owner"""
ORACLES["tool_ranking"] = f"""WITH RECURSIVE {PERF},
pv AS (SELECT owner, audit, dataset_type, es.tool, CASE WHEN first_critical IS NOT NULL THEN efficiency / (es.position + 1) ELSE 0.5 END AS value
  FROM pf JOIN es USING (owner, audit)),
{fold('pv', 'owner, dataset_type, tool', False)}
SELECT owner, dataset_type, tool, row_number() OVER (PARTITION BY owner, dataset_type ORDER BY round(e, 9) DESC, tool) AS place
FROM w WHERE i = last"""
_PLAN_VALUES = "(VALUES " + ", ".join(
    f"('{p[0]}', {p[1]}, {q(p[2]) if p[2] else 'NULL'}, {q(p[7]) if p[7] else 'NULL'}, {len(p[9])})" for p in PLANS
) + ") pl(trigger, priority, auto_remediation, change_goal, recs)"
_RULES = (
    ("leakage_detected", "leaks > 0"),
    ("severe_class_imbalance", "severe > 0"),
    ("contamination_detected", "overlapped > 0"),
    ("multiple_critical_issues", "criticals >= 3"),
    ("high_spurious_correlation", "spurious >= 10"),
    ("low_feature_quality", "utility > tools * 3"),
    ("no_issues_found_yet", "criticals = 0 AND tools >= 2"),
    ("approaching_time_limit", "time_used > 180.0::DOUBLE * 0.7::DOUBLE"),
)
TRIGGERS = f"""{EF}, fx AS (SELECT dataset, count(*) FILTER (WHERE tool = 'leakage_detector' AND severity = 'critical') AS leaks,
  count(*) FILTER (WHERE type = 'severe_imbalance') AS severe,
  count(*) FILTER (WHERE tool = 'contamination_detector' AND severity = 'critical') AS overlapped,
  count(*) FILTER (WHERE severity = 'critical') AS criticals, count(*) FILTER (WHERE tool = 'spurious_detector') AS spurious,
  count(*) FILTER (WHERE tool = 'feature_utility') AS utility, count(DISTINCT tool) AS tools,
  sum(CAST(round(value * 100) AS BIGINT)) / 100.0::DOUBLE AS time_used FROM ef GROUP BY dataset),
tr AS ({union(f"SELECT dataset, '{n}' AS trigger, {i} AS rule FROM fx WHERE {c}" for i, (n, c) in enumerate(_RULES))}),
tp AS (SELECT tr.dataset, pl.*, row_number() OVER (PARTITION BY dataset ORDER BY priority DESC, rule) AS place
  FROM tr JOIN {_PLAN_VALUES} USING (trigger))"""
ORACLES["contingency_triggers"] = f"WITH {TRIGGERS} SELECT dataset, trigger, CAST(priority AS BIGINT) AS priority, place, change_goal FROM tp"
ORACLES["remediations"] = f"""WITH {TRIGGERS} SELECT dataset, trigger, auto_remediation AS remediation_type, CAST(priority AS BIGINT) AS priority
FROM tp WHERE auto_remediation IS NOT NULL"""
_CHANGES = (
    "(VALUES ('leakage_detected', 'skip_threshold', 0.6::DOUBLE), ('multiple_critical_issues', 'skip_threshold', 0.2), "
    "('multiple_critical_issues', 'critical_threshold', 0.5), ('no_issues_found_yet', 'skip_threshold', 0.3), "
    "('approaching_time_limit', 'skip_threshold', 0.55)) ch(trigger, threshold, value)"
)
ORACLES["adjusted_thresholds"] = f"""WITH {TRIGGERS} SELECT dataset, threshold, arg_min(ch.value, place) AS value
FROM tp JOIN {_CHANGES} USING (trigger) GROUP BY dataset, threshold"""
ORACLES["contingency_summary"] = f"""WITH {TRIGGERS} SELECT dataset, count(*) AS plans_triggered, CAST(sum(recs) AS BIGINT) AS total_recommendations,
  count(auto_remediation) AS auto_remediations_available FROM tp GROUP BY dataset"""

# --- generators ---


def unit(stream: str, seed: int) -> str:
    return f"(CAST(('0x' || substr(md5(concat_ws('|', '{seed}', '{stream}', CAST(o_orderkey AS VARCHAR))), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


def whole(stream: str, low: int, high: int, seed: int) -> str:
    return f"CAST(floor({unit(stream, seed)} * {high - low}) + {low} AS INT)"


def normal(stream: str, seed: int) -> str:
    return f"(sqrt(-2 * ln(1 - {unit(stream + '/r', seed)})) * cos(2 * pi() * {unit(stream + '/a', seed)}))"


def minority(seed: int, share: float) -> str:
    rank = f"row_number() OVER (ORDER BY md5(concat_ws('|', '{seed}', CAST(o_orderkey AS VARCHAR))))"
    return f"CASE WHEN {rank} <= floor((SELECT count(*) FROM orders) * {share}::DOUBLE) THEN 1 ELSE 0 END"


ORACLES["generate_leakage"] = f"""SELECT *, CAST(credit_score < 600 AS INT) AS "default", CAST(credit_score < 600 AS INT) AS will_default FROM (
SELECT o_orderkey AS customer_id, {whole('age', 18, 80, 42)} AS age, {whole('income', 20000, 150000, 42)} AS income,
  {whole('credit_score', 300, 850, 42)} AS credit_score FROM orders)"""
ORACLES["generate_imbalance"] = f"""SELECT {', '.join(f"{r(normal(f'feature_{k}', 43))} AS feature_{k}" for k in (1, 2, 3))},
  {r(unit('feature_4', 43) + ' * 100')} AS feature_4, {r('-2.0 * ln(1 - ' + unit('feature_5', 43) + ')')} AS feature_5,
  {minority(43, 0.03)} AS target FROM orders"""
ORACLES["generate_clean"] = f"""SELECT {r('170 + 10 * ' + normal('height', 44))} AS height, {r('70 + 15 * ' + normal('weight', 44))} AS weight,
  {whole('age', 18, 65, 44)} AS age, CAST({unit('category', 44)} < 0.5 AS INT) AS category FROM orders"""
ORACLES["generate_wide"] = f"""WITH g AS (SELECT {', '.join(f"{normal(f'feature_{k}', 45)} AS feature_{k}" for k in range(4))},
  {whole('year', 2020, 2024, 45)} AS year, {whole('month', 1, 13, 45)} AS month, o_orderkey AS transaction_id,
  {minority(45, 0.08)} AS fraud, {normal('future_flag', 45)} AS noise FROM orders)
SELECT {', '.join(f'{r(f"feature_{k}")} AS feature_{k}' for k in range(4))}, year, month, transaction_id, fraud,
  CAST(fraud + noise * 0.3 > 0.5 AS INT) AS future_flag FROM g"""
ORACLES["generate_multi_issue"] = f"""WITH g AS (SELECT o_orderkey AS user_id, {r(normal('feature_A', 46))} AS "feature_A", {r(normal('feature_B', 46))} AS "feature_B",
  {r(unit('feature_C', 46) + ' * 100')} AS "feature_C", {minority(46, 0.05)} AS churned FROM orders),
h AS (SELECT *, churned AS churn_probability FROM g)
SELECT * FROM h UNION ALL SELECT * FROM h WHERE user_id < 100"""
ORACLES["generate_drift"] = union(
    f"""SELECT '{v}' AS version, {', '.join(f"{r(normal(f'feature_{k}', s))} AS feature_{k}" for k in (1, 2, 3))},
    {minority(s, share)} AS target FROM orders"""
    for v, s, share in (("v1", 47, 0.10), ("v2", 48, 0.12))
)

# --- whole audits ---

ORACLES["audit_split_findings"] = f"""WITH d AS (SELECT doc_id % 10 < 7 AS train, text, lang FROM documents),
c AS (SELECT 'exact_duplicates_train' AS type, 'warning' AS severity, (SELECT count(*) - count(DISTINCT (text, lang)) FROM d WHERE train) * 100.0
    / (SELECT count(*) FROM d WHERE train) AS metric
UNION ALL SELECT 'exact_duplicates_test', 'warning', (SELECT count(*) - count(DISTINCT (text, lang)) FROM d WHERE NOT train) * 100.0
    / (SELECT count(*) FROM d WHERE NOT train)
UNION ALL SELECT unnest(['train_test_contamination', 'hash_contamination']), 'critical',
  (SELECT count(*) FROM d WHERE NOT train AND (text, lang) IN (SELECT (text, lang) FROM d WHERE train)) * 100.0 / (SELECT count(*) FROM d WHERE NOT train))
SELECT type, severity, {r('metric')} AS metric FROM c WHERE metric > CASE type WHEN 'hash_contamination' THEN 0.1 ELSE 0 END"""
