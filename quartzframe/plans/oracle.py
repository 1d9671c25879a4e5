"""DuckDB SQL of the queries, on the same tables."""

from __future__ import annotations

from quartzframe.operators import governance, images

_BOXES = """g AS (
  SELECT o_orderkey AS gt_id, 'im' || (o_orderkey // 30) AS image_id, (o_orderkey % 3)::INT AS class_id, (o_custkey % 80 * 10)::DOUBLE AS x, (o_orderkey % 70 * 10)::DOUBLE AS y,
         (o_custkey % 40 + 10)::DOUBLE AS w, (o_orderkey % 45 + 10)::DOUBLE AS h FROM orders),
p AS (
  SELECT gt_id AS pred_id, image_id, class_id, ('0x' || substr(md5(gt_id::VARCHAR), 1, 6))::BIGINT / 16777216.0::DOUBLE AS score, x + gt_id % 5 AS x, y + gt_id % 4 AS y, w, h FROM g WHERE gt_id % 7 <> 0)"""

_AP = _BOXES + """,
o AS (
  SELECT pred_id, gt_id, inter / (aw + bw - inter) AS iou FROM (
    SELECT p.pred_id, g.gt_id, p.w * p.h AS aw, g.w * g.h AS bw,
           greatest(least(p.x + p.w, g.x + g.w) - greatest(p.x, g.x), 0) * greatest(least(p.y + p.h, g.y + g.h) - greatest(p.y, g.y), 0) AS inter
    FROM p JOIN g USING (image_id, class_id)) WHERE inter > 0),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pred_id ORDER BY iou DESC, gt_id) AS r FROM o) WHERE r = 1),
m AS (
  SELECT t AS threshold, p.pred_id, p.class_id, p.score, b.gt_id, coalesce(b.iou >= t, false) AS reached
  FROM p LEFT JOIN best b USING (pred_id) CROSS JOIN (SELECT unnest({thresholds})::DOUBLE AS t)),
f AS (SELECT *, (reached AND row_number() OVER (PARTITION BY threshold, gt_id, reached ORDER BY score DESC, pred_id) = 1)::INT AS tp FROM m),
c AS (SELECT *, sum(tp) OVER w / count(*) OVER w AS prec FROM f WINDOW w AS (PARTITION BY threshold, class_id ORDER BY score DESC, pred_id ROWS UNBOUNDED PRECEDING)),
e AS (SELECT *, max(prec) OVER (PARTITION BY threshold, class_id ORDER BY score DESC, pred_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM c),
ap AS (
  SELECT threshold, class_id, n_gt, n_pred, area / n_gt AS ap FROM (SELECT class_id, count(*) AS n_gt FROM g GROUP BY 1)
  JOIN (SELECT threshold, class_id, count(*) AS n_pred, sum(env) FILTER (tp = 1) AS area FROM e GROUP BY 1, 2) USING (class_id))"""

_CLF = """p AS (SELECT quality AS y_true, (n_chars > 1000)::INT AS y_pred, n_chars::DOUBLE AS y_score, lang, source, n_chars FROM documents JOIN labels USING (doc_id))"""

_LABEL = """s AS (SELECT {keys} y_true AS label, 1 AS is_true, (y_true = y_pred)::INT AS hit FROM {rows} UNION ALL SELECT {keys} y_pred, 0, (y_true = y_pred)::INT FROM {rows}),
l AS (
  SELECT *, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall,
         CASE WHEN support + n_pred > 0 THEN 2 * tp / (support + n_pred) ELSE 0 END AS f1
  FROM (SELECT {keys} label, sum(hit * is_true)::BIGINT AS tp, sum(is_true)::BIGINT AS support, sum(1 - is_true)::BIGINT AS n_pred FROM s GROUP BY {keys} label))"""

_CLF_SUMMARY = """SELECT sum(support)::BIGINT AS n, round(sum(tp) / sum(support), 6) AS accuracy, round(avg(precision), 6) AS precision_macro, round(avg(recall), 6) AS recall_macro,
  round(avg(f1), 6) AS f1_macro, round(sum(f1 * support) / sum(support), 6) AS f1_weighted FROM l"""

_REG = """r AS (
  SELECT l_extendedprice AS y_true, m AS y_pred, l_returnflag, l_linestatus, l_discount, l_quantity FROM lineitem
  JOIN (SELECT l_quantity, round(avg(l_extendedprice), 4) AS m FROM lineitem GROUP BY 1) USING (l_quantity))"""

_MATCHES = """m AS (
  SELECT o_orderkey AS seq, 'm' || o_orderkey AS match_id, slot, 'agent' || CASE slot WHEN 0 THEN o_custkey % 4 ELSE (o_custkey % 4 + 1 + o_orderkey % 3) % 4 END AS agent,
         (CASE slot WHEN 0 THEN floor(o_totalprice)::BIGINT % 3 ELSE floor(o_totalprice)::BIGINT % 5 % 3 END)::DOUBLE AS reward,
         CASE WHEN o_orderkey % 97 = 0 THEN 'TIMEOUT' ELSE 'DONE' END AS status
  FROM orders CROSS JOIN (SELECT unnest([0, 1])::INT AS slot)),
mo AS (
  SELECT *, CASE WHEN reward IS NULL THEN 'unknown' WHEN reward < best THEN 'loss' WHEN count(*) FILTER (reward = best) OVER (PARTITION BY match_id) > 1 THEN 'draw' ELSE 'win' END AS outcome
  FROM (SELECT *, max(reward) OVER (PARTITION BY match_id) AS best FROM m)),
wm AS (SELECT a.agent AS winner, b.agent AS loser, count(*) AS wins FROM m a JOIN m b ON a.match_id = b.match_id AND a.reward > b.reward AND a.agent <> b.agent GROUP BY 1, 2),
ms AS (
  SELECT agent, opponent, sum(wins)::BIGINT AS wins, sum(losses)::BIGINT AS losses, sum(wins) / (sum(wins) + sum(losses)) AS share FROM (
    SELECT winner AS agent, loser AS opponent, wins, 0 AS losses FROM wm UNION ALL SELECT loser, winner, 0, wins FROM wm) GROUP BY 1, 2),
wr AS (
  SELECT agent, count(*) AS played, count(*) FILTER (outcome = 'win') AS wins, count(*) FILTER (outcome = 'draw') AS draws, count(*) FILTER (outcome = 'loss') AS losses, count(*) FILTER (status = 'TIMEOUT') AS invalid
  FROM mo GROUP BY 1)"""

_SUBMISSION = """e AS (SELECT o_orderkey AS line, 'o' || o_orderkey AS id, '0.5' AS prediction, 'a' AS note FROM orders),
s AS (
  SELECT o_orderkey AS line, CASE WHEN o_orderkey % 211 = 0 THEN 'o' || (o_orderkey - 1) WHEN o_orderkey % 223 = 0 THEN 'z' || o_orderkey ELSE 'o' || o_orderkey END AS id,
         CASE WHEN o_orderkey % 101 = 0 THEN 'nan' WHEN o_orderkey % 103 = 0 THEN 'high' WHEN o_orderkey % 107 = 0 THEN '1_000' ELSE round(o_totalprice, 2)::VARCHAR END AS prediction, 'a' AS note
  FROM orders WHERE o_orderkey % 199 <> 0),
cells AS (SELECT 'prediction' AS "column", prediction AS cell FROM s UNION ALL SELECT 'note', note FROM s),
kinds AS (SELECT "column", cell, CASE WHEN cell IN ('', 'nan', 'NaN', 'NA', 'null', 'None') THEN 'missing' WHEN regexp_full_match(cell, '[0-9_]+([.][0-9]*)?([eE][-+]?[0-9]+)?') THEN 'number' ELSE 'text' END AS kind FROM cells),
cols AS (
  SELECT "column", count(*) FILTER (kind = 'missing') AS n_missing, count(*) FILTER (kind = 'text') AS n_text, count(DISTINCT cell) AS n_values, "column" = 'prediction' AS expects_number,
         count(DISTINCT kind) FILTER (kind <> 'missing') = 1 AND count(DISTINCT cell) = 1 AS constant
  FROM kinds GROUP BY 1),
rep AS (SELECT line, id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line) AS n FROM s) WHERE n > 1),
mis AS (SELECT id FROM e WHERE id NOT IN (SELECT id FROM s)),
ext AS (SELECT DISTINCT id FROM s WHERE id NOT IN (SELECT id FROM e))"""

_GROUPS = """items AS (SELECT doc_id AS item, doc_id // 3 AS base, md5(text) AS cluster FROM documents),
edges AS (
  SELECT a.item AS a, b.item AS b FROM items a JOIN items b ON a.base = b.base AND a.item <> b.item
  UNION SELECT a.item, b.item FROM items a JOIN items b ON a.cluster = b.cluster AND a.item <> b.item),
reach AS (SELECT item, item AS other FROM items UNION SELECT r.item, e.b FROM reach r JOIN edges e ON r.other = e.a),
comp AS (SELECT item, min(other) AS component FROM reach GROUP BY 1)"""


def _split(table: str, key: str, seed: int, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    return f"""(SELECT *, CASE WHEN r < round_even(n * 0.7, 0) THEN 'train' WHEN r < round_even(n * 0.7, 0) + round_even(n * 0.15, 0) THEN 'val' ELSE 'test' END AS split FROM (
      SELECT *, row_number() OVER ({part} ORDER BY md5('{seed}:' || {key}), {key}) - 1 AS r, (count(*) OVER ({part}))::DOUBLE AS n FROM {table}))"""


def _numeric_psi(features: dict[str, str], ref: str, cur: str) -> str:
    """A subquery fp(feature, psi, n_bins) for numeric features: name to expression; ref and cur are FROM clauses."""
    melt = lambda side: " UNION ALL ".join(f"SELECT '{f}' AS feature, ({e})::DOUBLE AS v FROM {side}" for f, e in features.items())
    return f"""r AS ({melt(ref)}), c AS ({melt(cur)}),
ed AS (SELECT feature, list_sort(list_distinct(quantile_cont(v, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) AS es FROM r GROUP BY 1),
ine AS (SELECT feature, list_slice(es, 2, len(es) - 1) AS es FROM ed WHERE len(es) >= 3),
b AS (
  SELECT feature, bin, sum(e)::DOUBLE AS e, sum(a)::DOUBLE AS a FROM (
    SELECT feature, CASE WHEN v IS NULL THEN -1 ELSE len(list_filter(es, lambda x: x < v)) END AS bin, 1 AS e, 0 AS a FROM r JOIN ine USING (feature)
    UNION ALL SELECT feature, CASE WHEN v IS NULL THEN -1 ELSE len(list_filter(es, lambda x: x < v)) END, 0, 1 FROM c JOIN ine USING (feature)
    UNION ALL SELECT feature, unnest(range(-1, len(es) + 1)), 0, 0 FROM ine) GROUP BY 1, 2),
sh AS (SELECT feature, (e + 0.5) / (sum(e) OVER w + 0.5 * count(*) OVER w) AS se, (a + 0.5) / (sum(a) OVER w + 0.5 * count(*) OVER w) AS sa FROM b WINDOW w AS (PARTITION BY feature)),
fp AS (SELECT feature, sum((sa - se) * ln(sa / se)) AS psi, count(*) AS n_bins FROM sh GROUP BY 1)"""


def _categorical_psi(features: dict[str, str], ref: str, cur: str) -> str:
    """Subqueries ending in cp(feature, psi, n_bins, tvd, unseen_share)."""
    melt = lambda side, e, a: " UNION ALL ".join(f"SELECT '{f}' AS feature, ({x})::VARCHAR AS v, {e} AS e, {a} AS a FROM {side}" for f, x in features.items())
    return f"""cc AS (SELECT feature, v, sum(e)::BIGINT AS e, sum(a)::BIGINT AS a FROM ({melt(ref, 1, 0)} UNION ALL {melt(cur, 0, 1)}) GROUP BY 1, 2),
ck AS (SELECT *, CASE WHEN e = 0 THEN 'unseen' WHEN row_number() OVER (PARTITION BY feature ORDER BY e DESC, v NULLS FIRST) > 20 THEN 'other' ELSE 'value' END AS kind FROM cc),
cb AS (
  SELECT feature, kind, bin, sum(e)::DOUBLE AS e, sum(a)::DOUBLE AS a FROM (
    SELECT feature, kind, CASE WHEN kind = 'value' THEN v END AS bin, e, a FROM ck
    UNION ALL SELECT DISTINCT feature, k, NULL, 0, 0 FROM cc CROSS JOIN (SELECT unnest(['other', 'unseen']) AS k)) GROUP BY 1, 2, 3),
cs AS (
  SELECT *, (e + 0.5) / (sum(e) OVER w + 0.5 * count(*) OVER w) AS se, (a + 0.5) / (sum(a) OVER w + 0.5 * count(*) OVER w) AS sa, sum(e) OVER w AS te, sum(a) OVER w AS ta
  FROM cb WINDOW w AS (PARTITION BY feature)),
cp AS (
  SELECT feature, sum((sa - se) * ln(sa / se)) AS psi, count(*) AS n_bins, 0.5 * sum(abs(a / ta - e / te)) AS tvd, sum(CASE WHEN kind = 'unseen' THEN a ELSE 0 END) / sum(a) AS unseen_share FROM cs GROUP BY 1)"""


_EREF, _ECUR = "events WHERE ts < TIMESTAMP '2024-01-21'", "events WHERE ts >= TIMESTAMP '2024-01-21'"
_LREF, _LCUR = "lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01'", "lineitem WHERE NOT l_shipdate < TIMESTAMP '1996-01-01'"
_BAND = "CASE WHEN psi < 0.1 THEN 'none' WHEN psi < 0.25 THEN 'moderate' ELSE 'major' END"
_REPORT = (
    _numeric_psi({c: c for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_suppkey")}, _LREF, _LCUR)
    + ", "
    + _categorical_psi({c: c for c in ("l_returnflag", "l_linestatus")}, _LREF, _LCUR)
    + f""", rep AS (
  SELECT feature, type, round(psi, 6) AS psi, round(tvd, 6) AS tvd, round(unseen_share, 6) AS unseen_share, n AS n_cur, n < 200 AS low_n, {_BAND} AS band FROM (
    SELECT feature, 'numeric' AS type, psi, NULL::DOUBLE AS tvd, NULL::DOUBLE AS unseen_share FROM fp UNION ALL SELECT feature, 'categorical', psi, tvd, unseen_share FROM cp)
  CROSS JOIN (SELECT count(*) AS n FROM {_LCUR}))"""
)


def _pearson(rows: str, x: str, y: str) -> str:
    return f"SELECT count(*) AS n, round(corr({x}, {y}), 6) AS r FROM {rows} WHERE {x} IS NOT NULL AND {y} IS NOT NULL"


def _chi2(rows: str, x: str, y: str) -> str:
    return f"""WITH c AS (SELECT {x} AS x, {y} AS y, count(*)::DOUBLE AS o FROM {rows} WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY 1, 2),
rx AS (SELECT x, sum(o) AS rx FROM c GROUP BY 1), ry AS (SELECT y, sum(o) AS ry FROM c GROUP BY 1),
g AS (SELECT coalesce(o, 0) AS o, rx * ry / (SELECT sum(o) FROM c) AS e FROM rx CROSS JOIN ry LEFT JOIN c USING (x, y)),
s AS (SELECT (SELECT sum(o) FROM c)::BIGINT AS n, (SELECT count(*) FROM rx) AS n_x, (SELECT count(*) FROM ry) AS n_y),
k AS (SELECT n, n_x, n_y, sum(pow(abs(o - e) - CASE WHEN n_x = 2 AND n_y = 2 THEN least(0.5, abs(o - e)) ELSE 0 END, 2) / e) AS chi2 FROM g CROSS JOIN s GROUP BY 1, 2, 3)
SELECT n, n_x, n_y, (n_x - 1) * (n_y - 1) AS dof, round(chi2, 6) AS chi2, round(sqrt(chi2 / (n * (least(n_x, n_y) - 1))), 6) AS cramers_v FROM k"""


def _parts() -> str:
    return """p AS (SELECT o_custkey AS x, o_totalprice AS y, ntile(5) OVER (ORDER BY md5('0:' || o_orderkey), o_orderkey) - 1 AS part FROM orders)"""


def _infer(target: str, rows: str, floating: bool, number: bool) -> str:
    fractional = f"coalesce(bool_or({target} % 1 <> 0), false)" if floating else "false"
    return f"""SELECT *, {str(number).lower()} AND task = 'classification' AND n_distinct BETWEEN 3 AND 20 AS ordinal_warning, '{target}' AS target FROM (
  SELECT *, CASE WHEN fractional OR ({str(floating).lower()} AND n_distinct > 20) OR n_distinct > greatest(20, floor(n * 0.05)) THEN 'regression' ELSE 'classification' END AS task FROM (
    SELECT count(*) AS n, count(DISTINCT {target}) AS n_distinct, {fractional} AS fractional FROM {rows}))"""


def _slices_clf() -> str:
    return f"""WITH {_CLF},
top AS (SELECT feature, v FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, v) AS r FROM (
  SELECT 'lang' AS feature, lang AS v, count(*) AS n FROM p GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM p GROUP BY 2)) WHERE r <= 12),
q AS (SELECT list_sort(list_distinct(quantile_cont(y_score, [0, .2, .4, .6, .8, 1]))) AS es FROM p),
sl AS (
  SELECT y_true, y_pred, x.feature, coalesce(top.v, '(other)') AS grp FROM (SELECT y_true, y_pred, 'lang' AS feature, lang AS v FROM p UNION ALL SELECT y_true, y_pred, 'source', source FROM p) x LEFT JOIN top ON x.feature = top.feature AND x.v = top.v
  UNION ALL SELECT y_true, y_pred, 'n_chars', 'q' || (len(list_filter(list_slice(es, 2, len(es) - 1), lambda x: x < y_score)) + 1) FROM p CROSS JOIN q),
{_LABEL.format(keys="feature, grp,", rows="sl")}
SELECT feature, grp AS "group", sum(support)::BIGINT AS n, round(avg(f1), 6) AS metric FROM l GROUP BY 1, 2 HAVING sum(support) >= 20 ORDER BY avg(f1), 1, 2 LIMIT 8"""


def _slices_reg() -> str:
    return f"""WITH {_REG},
q AS (SELECT list_sort(list_distinct(quantile_cont(l_quantity, [0, .2, .4, .6, .8, 1]))) AS es FROM r),
t AS (SELECT l_discount AS v FROM r GROUP BY 1 ORDER BY count(*) DESC, v::VARCHAR LIMIT 12),
sl AS (
  SELECT y_true, y_pred, 'l_returnflag' AS feature, l_returnflag AS grp FROM r
  UNION ALL SELECT y_true, y_pred, 'l_quantity', 'q' || (len(list_filter(list_slice(es, 2, len(es) - 1), lambda x: x < l_quantity)) + 1) FROM r CROSS JOIN q
  UNION ALL SELECT y_true, y_pred, 'l_discount', CASE WHEN l_discount IN (SELECT v FROM t) THEN l_discount::VARCHAR ELSE '(other)' END FROM r)
SELECT feature, grp AS "group", count(*) AS n, round(avg(abs(y_true - y_pred)), 4) AS metric FROM sl GROUP BY 1, 2 HAVING count(*) >= 20"""


def _grid_hash(positions: list[int]) -> str:
    return " || ".join(f"CASE WHEN embedding[{positions[r * 8 + c + 1] + 1}] > embedding[{positions[r * 8 + c] + 1}] THEN '1' ELSE '0' END" for r in range(8) for c in range(7))


def _windowed() -> str:
    return f"""WITH q AS (SELECT list_sort(list_distinct(quantile_cont(value, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) AS es FROM {_EREF}),
bins AS (SELECT unnest(range(-1, len(es) - 1)) AS bin FROM q),
f AS (SELECT CASE WHEN value IS NULL THEN -1 ELSE len(list_filter(list_slice(es, 2, len(es) - 1), lambda x: x < value)) END AS bin FROM (SELECT * FROM {_EREF}) CROSS JOIN q),
e AS (SELECT bin, (SELECT count(*) FROM f WHERE f.bin = bins.bin) AS e FROM bins),
c AS (SELECT date_trunc('day', ts) AS window_start, CASE WHEN value IS NULL THEN -1 ELSE len(list_filter(list_slice(es, 2, len(es) - 1), lambda x: x < value)) END AS bin FROM (SELECT * FROM {_ECUR}) CROSS JOIN q),
d AS (SELECT window_start, count(*) AS n FROM c GROUP BY 1),
g AS (SELECT window_start, n, bin, e, (SELECT count(*) FROM c WHERE c.bin = e.bin AND c.window_start = d.window_start) AS a FROM d CROSS JOIN e),
s AS (SELECT window_start, n, (e + 0.5) / (sum(e) OVER w + 0.5 * count(*) OVER w) AS se, (a + 0.5) / (n + 0.5 * count(*) OVER w) AS sa FROM g WINDOW w AS (PARTITION BY window_start))
SELECT window_start::TIMESTAMP AS window_start, n, round(sum((sa - se) * ln(sa / se)), 6) AS psi FROM s GROUP BY 1, 2"""


def _candidates() -> str:
    rows = "(SELECT 'seq' || (user_id % 20) || '_frame_' || event_id AS stem FROM events)"
    one = lambda i, p: f"""SELECT {i} AS pattern_no, '{p}' AS pattern, count(DISTINCT k) AS n_groups, count(k) AS matched, count(*) AS n FROM (
      SELECT nullif(regexp_extract(stem, '{p}', 1), '') AS k FROM {rows})"""  # noqa: E731
    every = " UNION ALL ".join(one(i, p) for i, p in enumerate(images.GROUP_PATTERNS))
    return f"SELECT *, matched >= 0.95 * n AND n_groups > 1 AND n_groups < n AS useful FROM ({every}) WHERE matched > 0"


def _competition() -> str:
    required = ["name", "platform", "track", "metric", "direction", "deadline", "accepted", "scheme"]
    names = dict(zip(required, governance.REQUIRED, strict=True))
    missing = ", ".join(f"CASE WHEN {c} IS NULL OR trim({c}) = '' THEN '{names[c]}' END" for c in required)
    return f"""WITH f AS (
  SELECT o_orderkey AS id, 'c' || o_orderkey AS name, CASE WHEN o_orderkey % 7 = 0 THEN 'elsewhere' ELSE 'kaggle' END AS platform, CASE WHEN o_orderkey % 5 = 0 THEN 'cv-detection' ELSE 'tabular' END AS track,
         CASE WHEN o_orderkey % 11 <> 0 THEN 'auc' END AS metric, 'maximize' AS direction, CASE WHEN o_orderkey % 13 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS deadline,
         (o_orderkey % 3 <> 0)::VARCHAR AS accepted, ' ' AS scheme FROM orders),
g AS (
  SELECT id, CASE track WHEN 'tabular' THEN 'model-builder' ELSE 'cv-modeler' END AS pipeline, date_diff('day', DATE '1998-01-01', try_cast(deadline AS DATE))::INT AS days_left,
         array_to_string(list_filter([{missing}, CASE WHEN accepted = 'false' THEN 'rules.rules_accepted' END], lambda x: x IS NOT NULL), ',') AS missing_required,
         array_to_string(list_filter([CASE WHEN platform = 'elsewhere' THEN 'platform' END, CASE WHEN deadline = 'soon' THEN 'deadlines.final_submission' END], lambda x: x IS NOT NULL), ',') AS problems FROM f)
SELECT id, CASE WHEN missing_required = '' AND problems = '' THEN 'READY' ELSE 'INCOMPLETE' END AS status, pipeline, days_left, missing_required, problems FROM g"""


def _readiness() -> str:
    return """WITH a AS (
  SELECT s_suppkey AS pipeline, s_suppkey AS k, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 9 <> 0 END AS no_overlap, round(s_acctbal, 2) AS b, round(s_acctbal + s_suppkey % 3 - 1, 2) AS t,
         CASE WHEN s_suppkey % 5 <> 0 THEN 'val' END AS bo, CASE WHEN s_suppkey % 7 <> 0 THEN CASE WHEN s_suppkey % 8 = 0 THEN 'test' ELSE 'val' END END AS tuned_on FROM supplier),
c AS (
  SELECT pipeline, 1.0 AS w, CASE WHEN no_overlap AND k % 2 = 0 THEN 'PASS' ELSE 'FAIL' END AS s FROM a
  UNION ALL SELECT pipeline, 0.5, CASE WHEN no_overlap IS NULL THEN 'FAIL' WHEN k % 3 = 0 OR k % 6 = 1 THEN 'PASS' ELSE 'PARTIAL' END FROM a
  UNION ALL SELECT pipeline, 1.0, CASE WHEN bo IS NULL THEN 'FAIL' ELSE 'PASS' END FROM a
  UNION ALL SELECT pipeline, 1.0, CASE WHEN bo IS NULL AND tuned_on IS NULL THEN 'FAIL' WHEN bo = tuned_on AND CASE WHEN k % 2 = 0 THEN t < b ELSE t > b END THEN 'PASS' ELSE 'PARTIAL' END FROM a
  UNION ALL SELECT pipeline, 1.0, CASE WHEN k % 10 <> 0 AND k % 3 <> 0 THEN 'PASS' ELSE 'FAIL' END FROM a
  UNION ALL SELECT pipeline, 0.5, CASE WHEN k % 5 = 1 THEN 'FAIL' WHEN k % 2 > 0 THEN 'PASS' ELSE 'PARTIAL' END FROM a
  UNION ALL SELECT pipeline, 1.0, CASE WHEN k % 10 = 0 THEN 'FAIL' WHEN k % 11 <> 0 THEN 'PASS' ELSE 'PARTIAL' END FROM a
  UNION ALL SELECT pipeline, 1.0, CASE WHEN (bo IS NOT NULL OR tuned_on IS NOT NULL) AND coalesce(tuned_on, '') <> 'test' THEN 'PASS' ELSE 'PARTIAL' END FROM a),
p AS (SELECT pipeline, sum(w * CASE s WHEN 'PASS' THEN 1.0 WHEN 'PARTIAL' THEN 0.5 ELSE 0 END)::DOUBLE AS points, sum(w)::DOUBLE AS most, count(*) FILTER (s = 'FAIL') AS n_fail, count(*) FILTER (s = 'PARTIAL') AS n_partial FROM c GROUP BY 1)
SELECT *, round(points / most, 6) AS fraction, CASE WHEN points / most >= 0.8 THEN 'strong' WHEN points / most >= 0.5 THEN 'partial' ELSE 'weak' END AS label FROM p"""


#: A sample submission of file names; and the best four boxes of an image as conf x y w h.
_SAMPLE = """i AS (SELECT line, stem || '.png' AS image_id, stem FROM (
  SELECT DISTINCT o_orderkey // 30 AS line, 'im' || (o_orderkey // 30) AS stem FROM orders WHERE o_orderkey // 30 % 9 <> 0
  UNION ALL SELECT DISTINCT -(o_orderkey // 30) - 1, 'none' || (o_orderkey // 30) FROM orders WHERE o_orderkey // 30 % 9 <> 0))"""
_STREAK = """t AS (SELECT image_id, r, printf('%.6f %.2f %.2f %.2f %.2f', score, x, y, w, h) AS s FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, pred_id) AS r FROM p WHERE score >= 0.2) WHERE r <= 4)"""


def _elo() -> str:
    rating = lambda who: f"CASE g.{who} {' '.join(f"WHEN 'agent{i}' THEN f.r{i}" for i in range(4))} END"
    gain = f"(24 * (g.s - 1 / (1 + pow(10, ({rating('b')} - {rating('a')}) / 400))))"
    row = lambda value: "{'a': '', 'b': '', 's': 0.0::DOUBLE, " + ", ".join(f"'r{i}': {value(i)}" for i in range(4)) + "}"
    start = row(lambda i: "1500.0::DOUBLE")
    step = row(lambda i: f"f.r{i} + CASE 'agent{i}' WHEN g.a THEN {gain} WHEN g.b THEN -{gain} ELSE 0 END")
    return f"""WITH {_MATCHES},
games AS (
  SELECT a.seq, a.agent AS a, b.agent AS b, CASE WHEN a.reward > b.reward THEN 1.0 WHEN a.reward < b.reward THEN 0.0 ELSE 0.5 END::DOUBLE AS s
  FROM m a JOIN m b ON a.match_id = b.match_id AND a.slot = 0 AND b.slot = 1 WHERE a.agent <> b.agent),
fold AS (
  SELECT list_reduce(list({{'a': a, 'b': b, 's': s, 'r0': 0.0::DOUBLE, 'r1': 0.0::DOUBLE, 'r2': 0.0::DOUBLE, 'r3': 0.0::DOUBLE}} ORDER BY seq), lambda f, g: {step}, {start}) AS last FROM games)
{" UNION ALL ".join(f"SELECT 'agent{i}' AS agent, round(last.r{i}, 6) AS rating FROM fold" for i in range(4))}"""


def sql() -> dict[str, str]:
    train_val = lambda cols: f"WITH sp AS (SELECT {cols}, split FROM {_split('labels', 'doc_id', 42, 'quality')})"
    order_split = _split("(SELECT o_orderkey, o_totalprice FROM orders)", "o_orderkey", 42)
    coco = "[0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]"
    return {
        "drift_numeric_psi": f"WITH {_numeric_psi({'value': 'value'}, _EREF, _ECUR)} SELECT feature, round(psi, 6) AS psi, n_bins, {_BAND} AS band FROM fp",
        "drift_categorical_psi_tvd": f"WITH {_categorical_psi({'event_type': 'event_type', 'user_id': 'user_id'}, _EREF, _ECUR)} SELECT feature, round(psi, 6) AS psi, n_bins, round(tvd, 6) AS tvd, round(unseen_share, 6) AS unseen_share FROM cp",
        "drift_all_features": f"WITH {_REPORT} SELECT * FROM rep",
        "drift_summary": f"""WITH {_REPORT} SELECT count(*) AS n_features, count(*) FILTER (band = 'major') AS n_major, count(*) FILTER (band = 'moderate') AS n_moderate,
          CASE max(CASE band WHEN 'major' THEN 2 WHEN 'moderate' THEN 1 ELSE 0 END) WHEN 2 THEN 'major shift' WHEN 1 THEN 'moderate shift' ELSE 'stable' END AS overall, arg_max(feature, psi) AS top_feature, max(psi) AS top_psi,
          coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (low_n), '') AS low_n_features FROM rep""",
        "drift_frame_summary": f"""WITH {_REPORT}, x AS (SELECT * FROM rep WHERE feature NOT IN ('l_returnflag', 'l_linestatus'))
          SELECT count(*) AS n_features, count(*) FILTER (band = 'major') AS n_major, count(*) FILTER (band = 'moderate') AS n_moderate,
          CASE max(CASE band WHEN 'major' THEN 2 WHEN 'moderate' THEN 1 ELSE 0 END) WHEN 2 THEN 'major shift' WHEN 1 THEN 'moderate shift' ELSE 'stable' END AS overall, arg_max(feature, psi) AS top_feature, max(psi) AS top_psi,
          coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (low_n), '') AS low_n_features, (SELECT psi FROM rep WHERE feature = 'l_returnflag') AS target_psi, (SELECT psi FROM rep WHERE feature = 'l_linestatus') AS prediction_psi,
          array_to_string(list_filter(['l_discount', 'l_extendedprice', 'l_linenumber', 'l_quantity', 'l_suppkey', 'l_tax'], lambda f: NOT list_contains(list(feature), f)), ',') AS skipped_features, NULL::VARCHAR AS missing_target,
          (SELECT count(*) FROM {_LREF}) AS n_ref, (SELECT count(*) FROM {_LCUR}) AS n_cur, '' AS ref_only, '' AS cur_only FROM x""",
        "drift_ks_d": f"""WITH u AS (SELECT value AS v, 1 AS e, 0 AS a FROM {_EREF} UNION ALL SELECT value, 0, 1 FROM {_ECUR}), c AS (SELECT v, sum(e) AS e, sum(a) AS a FROM u WHERE v IS NOT NULL GROUP BY 1),
          f AS (SELECT sum(e) OVER (ORDER BY v) / sum(e) OVER () AS fe, sum(a) OVER (ORDER BY v) / sum(a) OVER () AS fa, sum(e) OVER () AS ne, sum(a) OVER () AS na FROM c)
          , k AS (SELECT max(abs(fe - fa)) AS d, max(ne)::BIGINT AS n, max(na)::BIGINT AS m FROM f), l AS (SELECT *, d * (sqrt(n * m / (n + m)) + 0.12 + 0.11 / sqrt(n * m / (n + m))) AS l FROM k)
          SELECT 'value' AS feature, round(d, 6) AS ks_d, round(CASE WHEN l < 0.2 THEN 1.0 ELSE greatest(0, least(1, 2 * list_sum(list_transform(range(1, 101), lambda j: CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END * exp(-2 * j * j * l * l))))) END::DOUBLE, 6) AS ks_p, n AS n_ref, m AS n_cur FROM l""",
        "drift_windowed_psi": _windowed(),
        "drift_schema_diff": "SELECT * FROM (VALUES ('props', 'reference only'), ('properties', 'current only')) AS t(\"column\", side)",
        "split_random": f"SELECT o_orderkey, split FROM {order_split}",
        "split_random_stratified": f"SELECT doc_id, quality, split FROM {_split('labels', 'doc_id', 42, 'quality')}",
        "split_group": """WITH g AS (SELECT user_id, row_number() OVER (ORDER BY md5('42:' || user_id), user_id) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM events)),
          h AS (SELECT *, ceil(0.3 * n) AS held, ceil(0.5 * ceil(0.3 * n)) AS t FROM g)
          SELECT event_id, user_id, CASE WHEN r < t THEN 'test' WHEN r < held THEN 'val' ELSE 'train' END AS split FROM events JOIN h USING (user_id)""",
        "split_holdout": """WITH g AS (SELECT user_id, row_number() OVER (ORDER BY md5('42:' || user_id), user_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM events))
          SELECT event_id, user_id, CASE WHEN r <= ceil(0.2 * n) THEN 'val' ELSE 'train' END AS split FROM events JOIN g USING (user_id)""",
        "value_kinds": r"""WITH c AS (SELECT n::INT AS n, cell FROM (VALUES (0, ' 1.5'), (1, '1e5'), (2, '1_000'), (3, '1d'), (4, '0x10'), (5, 'inf'), (6, '-Infinity'), (7, 'NA'), (8, ''), (9, 'nan'), (10, 'None'), (11, 'text'), (12, '.5'), (13, '5.'), (14, '1__0'), (15, '1e999'), (16, '+7'), (17, '--1')) AS v(n, cell))
          SELECT n, cell, CASE WHEN trim(cell) IN ('', 'NA', 'nan', 'None') OR regexp_full_match(lower(trim(cell)), '[+-]?(inf|infinity|nan)') THEN 'missing'
            WHEN NOT regexp_full_match(lower(trim(cell)), '[+-]?([0-9]+(_[0-9]+)*[.]?([0-9]+(_[0-9]+)*)?|[.][0-9]+(_[0-9]+)*)(e[+-]?[0-9]+(_[0-9]+)*)?') THEN 'text'
            WHEN coalesce(isfinite(try_cast(replace(trim(cell), '_', '') AS DOUBLE)), false) THEN 'number' ELSE 'missing' END AS kind FROM c""",
        "split_temporal": """SELECT o_orderkey, CASE WHEN r < round_even(n * 0.7, 0) THEN 'train' WHEN r < round_even(n * 0.7, 0) + round_even(n * 0.15, 0) THEN 'val' ELSE 'test' END AS split FROM (
          SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate NULLS LAST, o_orderkey) - 1 AS r, (count(*) OVER ())::DOUBLE AS n FROM orders)""",
        "split_leakage_check": f"""WITH s AS (SELECT * FROM {_split('(SELECT doc_id, source, text FROM documents)', 'doc_id', 42)})
          SELECT (SELECT count(*) FROM (SELECT doc_id FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS keys_in_several, (SELECT count(*) FROM (SELECT source FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS groups_in_several,
          (SELECT count(*) FROM (SELECT text FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS contents_in_several, (SELECT count(*) - count(DISTINCT text) FROM s) AS repeated_rows""",
        "split_class_balance": f"WITH s AS (SELECT split, quality, count(*) AS n FROM {_split('labels', 'doc_id', 42, 'quality')} GROUP BY 1, 2) SELECT split, quality AS class, n, round(n / sum(n) OVER (PARTITION BY split), 6) AS share FROM s",
        "split_target_stats": f"SELECT split, count(*) AS n_rows, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, round(min(o_totalprice), 4) AS min, round(max(o_totalprice), 4) AS max FROM {order_split} GROUP BY 1",
        "k_fold_stratified": "SELECT doc_id, quality, ((row_number() OVER (PARTITION BY quality ORDER BY md5('7:' || doc_id), doc_id) - 1) % 5)::INT AS fold FROM labels",
        "seeded_sample": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('3:' || o_orderkey), o_orderkey LIMIT 100",
        "duplicate_rows": "SELECT count(*) AS n_rows, count(DISTINCT text) AS n_distinct, count(*) - count(DISTINCT text) AS n_duplicates FROM documents",
        "drop_duplicates": "SELECT min(doc_id) AS doc_id, length(text)::INT AS n FROM documents GROUP BY text",
        "straddling_groups": f"SELECT user_id AS \"group\", count(DISTINCT split) AS n_sides FROM {_split('(SELECT event_id, user_id FROM events)', 'event_id', 42)} GROUP BY 1 HAVING count(DISTINCT split) > 1",
        "infer_task": " UNION ALL ".join([_infer("c_mktsegment", "customer", False, False), _infer("c_acctbal", "customer", True, True), _infer("c_nationkey", "customer", False, True), _infer("event_type", "events", False, False), _infer("user_id", "events", False, True)]),
        "fingerprint": """SELECT (SELECT count(*) FROM customer) AS n_rows, 4::INT AS n_features, 1::INT AS n_categorical, (count(DISTINCT c_name) > 50)::INT AS n_high_card, count(DISTINCT c_name) AS max_cardinality, 'classification' AS task,
          count(DISTINCT c_mktsegment) AS n_classes, round((SELECT min(n) / sum(n) FROM (SELECT count(*) AS n FROM customer GROUP BY c_mktsegment)), 6) AS minority_frac, (SELECT min(n) / sum(n) FROM (SELECT count(*) AS n FROM customer GROUP BY c_mktsegment)) < 0.1 AS imbalanced FROM customer""",
        "modality_flags": """SELECT "column", round(avg(regexp_matches(lower(v), '\\.(png|jpe?g|gif|bmp|tiff?|wav|mp3|flac|mp4|mov|avi|webp)$')::INT), 6) AS media_share, round(avg(len(regexp_extract_all(v, '\\S+'))), 6) AS mean_tokens, round(avg(length(v)), 6) AS mean_length,
          CASE WHEN avg(regexp_matches(lower(v), '\\.(png|jpe?g|gif)$')::INT) > 0.5 THEN 'media' WHEN avg(len(regexp_extract_all(v, '\\S+'))) > 5 OR avg(length(v)) > 50 THEN 'text' ELSE 'none' END AS flag
          FROM (SELECT 'text' AS "column", text AS v FROM documents UNION ALL SELECT 'lang', lang FROM documents UNION ALL SELECT 'source', source FROM documents) WHERE v IS NOT NULL GROUP BY 1""",
        "model_recommendation": """SELECT 'gradient_boosting' AS family, CASE WHEN count(*) <= 10000 AND count(DISTINCT c_mktsegment) <= 10 THEN 'tabpfn,' ELSE '' END || 'random_forest,regularized_linear,decision_tree' AS alternatives,
          count(DISTINCT c_name) > 50 AS prefer_native_categoricals, NULL::VARCHAR AS veto FROM customer""",
        "clf_metrics": f"WITH {_CLF}, {_LABEL.format(keys='', rows='p')} {_CLF_SUMMARY}",
        "clf_per_label": f"WITH {_CLF}, {_LABEL.format(keys='', rows='p')} SELECT label, tp, support, n_pred, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM l",
        "confusion": f"WITH {_CLF}, lab AS (SELECT y_true AS v FROM p UNION SELECT y_pred FROM p) SELECT a.v AS y_true, b.v AS y_pred, (SELECT count(*) FROM p WHERE y_true = a.v AND y_pred = b.v) AS n FROM lab a CROSS JOIN lab b",
        "roc_auc": f"""WITH {_CLF}, r AS (SELECT y_true, rank() OVER (ORDER BY y_score) + (count(*) OVER (PARTITION BY y_score) - 1) / 2 AS k FROM p)
          SELECT round((sum(k) FILTER (y_true = 1) - count(*) FILTER (y_true = 1) * (count(*) FILTER (y_true = 1) + 1) / 2) / (count(*) FILTER (y_true = 1) * count(*) FILTER (y_true = 0)), 6) AS auc, count(*) FILTER (y_true = 1) AS n_pos, count(*) FILTER (y_true = 0) AS n_neg FROM r""",
        "regression_metrics": f"""WITH {_REG} SELECT count(*) AS n, round(avg(abs(y_pred - y_true)), 4) AS mae, round(sqrt(avg(pow(y_pred - y_true, 2))), 4) AS rmse, round(1 - sum(pow(y_pred - y_true, 2)) / (var_pop(y_true) * count(*)), 4) AS r2,
          round(avg(y_pred - y_true), 4) AS bias, round(avg(abs((y_pred - y_true) / y_true)), 4) AS mape, round(stddev_samp(y_pred - y_true), 4) AS residual_std, round(max(y_pred - y_true), 4) AS residual_max, round(min(y_pred - y_true), 4) AS residual_min FROM r""",
        "slice_errors_worst8": _slices_clf(),
        "slice_errors_regression": _slices_reg(),
        "dummy_baseline_metrics": f"{train_val('doc_id, quality')}, top AS (SELECT quality FROM sp WHERE split = 'train' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), p AS (SELECT sp.quality AS y_true, top.quality AS y_pred FROM sp CROSS JOIN top WHERE split = 'val'), {_LABEL.format(keys='', rows='p')} {_CLF_SUMMARY}",
        "dummy_stratified": f"""{train_val('doc_id, quality')}, c AS (SELECT quality, sum(count(*)) OVER (ORDER BY quality) AS upto, sum(count(*)) OVER () AS total FROM sp WHERE split = 'train' GROUP BY 1),
          v AS (SELECT doc_id, quality, ('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM sp WHERE split = 'val')
          SELECT doc_id, v.quality AS y_true, min(c.quality) AS y_pred FROM v JOIN c ON u * total < upto GROUP BY 1, 2""",
        "dummy_regression": f"WITH s AS (SELECT * FROM {order_split}), m AS (SELECT quantile_cont(o_totalprice, 0.5) AS m FROM s WHERE split = 'train') SELECT count(*) AS n, round(avg(abs(m - o_totalprice)), 4) AS mae, round(avg(m - o_totalprice), 4) AS bias FROM s CROSS JOIN m WHERE split = 'val'",
        "metric_compare": f"WITH {_CLF}, {_LABEL.format(keys='', rows='p')} SELECT 'f1_macro' AS \"primary\", 'val' AS eval_on, round(avg(f1), 6) AS baseline, round(avg(f1) + 0.05, 6) AS tuned, 0.05::DOUBLE AS gain, 'beats baseline' AS verdict FROM l",
        "stat_corr": _pearson("lineitem", "l_quantity", "l_extendedprice"),
        "stat_welch": """WITH m AS (SELECT l_linestatus AS x, count(*)::DOUBLE AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v FROM lineitem GROUP BY 1), a AS (SELECT * FROM m ORDER BY x LIMIT 1), b AS (SELECT * FROM m ORDER BY x DESC LIMIT 1)
          SELECT a.x AS level_a, b.x AS level_b, a.n::BIGINT AS n_a, b.n::BIGINT AS n_b, round(a.m, 6) AS mean_a, round(b.m, 6) AS mean_b, round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS t,
          round(pow(a.v / a.n + b.v / b.n, 2) / (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)), 6) AS df, round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)), 6) AS cohens_d FROM a CROSS JOIN b""",
        "stat_mann_whitney": """WITH r AS (SELECT l_linestatus AS x, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS k FROM lineitem), t AS (SELECT sum(pow(n, 3) - n) AS ties FROM (SELECT count(*)::DOUBLE AS n FROM lineitem GROUP BY l_quantity))
          SELECT sum(k) FILTER (x = 'F') - count(*) FILTER (x = 'F') * (count(*) FILTER (x = 'F') + 1) / 2 AS u, count(*) FILTER (x = 'F') AS n_a, count(*) FILTER (x = 'O') AS n_b, any_value(ties) AS ties FROM r CROSS JOIN t""",
        "stat_anova": """WITH g AS (SELECT o_orderpriority AS x, count(*)::DOUBLE AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1), a AS (SELECT avg(o_totalprice) AS gm, var_pop(o_totalprice) * count(*) AS sst FROM orders)
          SELECT count(*) AS k, sum(n)::BIGINT AS n, round((sum(n * pow(m - gm, 2)) / (count(*) - 1)) / (sum((n - 1) * v) / (sum(n) - count(*))), 6) AS f, round(sum(n * pow(m - gm, 2)) / any_value(sst), 6) AS eta_squared FROM g CROSS JOIN a""",
        "stat_chi2": _chi2("orders", "o_orderpriority", "o_orderstatus"),
        "stat_chi2_yates": _chi2("labels", "quality", "toxic"),
        "stat_parts_r": f"WITH {_parts()} SELECT part::INT AS part, count(*) AS n, round(corr(x, y), 6) AS r FROM p GROUP BY 1",
        "stat_stability": f"""WITH {_parts()}, v AS (SELECT corr(x, y) AS r FROM p GROUP BY part), s AS (SELECT count(*) AS n_used, avg(r) AS m, var_samp(r) AS v, count(*) FILTER (r > 0) * count(*) FILTER (r < 0) > 0 AS f FROM v)
          SELECT n_used, round(m, 6) AS mean, round(v, 6) AS variance, f AS sign_flips, NOT f AND m <> 0 AND sqrt(v) < 0.5 * abs(m) AS stable FROM s""",
        "stat_largest_stratum": _pearson("(SELECT * FROM lineitem WHERE l_returnflag = (SELECT l_returnflag FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))", "l_quantity", "l_extendedprice"),
        "det_per_class_ap": f"WITH {_AP.format(thresholds='[0.5, 0.75]')} SELECT threshold, class_id, n_gt, n_pred, round(ap, 6) AS ap FROM ap",
        "det_map50": f"WITH {_AP.format(thresholds='[0.5]')} SELECT round(avg(m), 6) AS map, count(*) AS n_thresholds FROM (SELECT avg(ap) AS m FROM ap GROUP BY threshold)",
        "det_coco_map": f"WITH {_AP.format(thresholds=coco)} SELECT round(avg(m), 6) AS map, count(*) AS n_thresholds FROM (SELECT avg(ap) AS m FROM ap GROUP BY threshold)",
        "det_caveats": f"""WITH {_BOXES}, i AS (SELECT image_id, count(*) AS n, min(score) AS s FROM p GROUP BY 1), r AS (SELECT max(n) AS a, min(s) AS b, count(*) AS c FROM i)
          SELECT a AS max_boxes_per_image, round(b, 6) AS min_confidence, c AS n_images, array_to_string(list_filter([CASE WHEN a > 100 THEN 'over 100 boxes in an image' END, CASE WHEN b < 0.05 THEN 'scores below 0.05' END, 'leaky split'], lambda x: x IS NOT NULL), '; ') AS caveats FROM r""",
        "det_class_map": "SELECT n_nationkey * 3 + 1 AS category_id, n_name AS name, (dense_rank() OVER (ORDER BY n_nationkey) - 1)::INT AS class_id FROM nation",
        "streak_submission": f"""WITH {_BOXES}, {_SAMPLE}, {_STREAK} SELECT i.line, i.image_id, coalesce(string_agg(s, ' ' ORDER BY r), '') AS prediction, count(s) AS n_boxes FROM i LEFT JOIN t ON i.stem = t.image_id GROUP BY 1, 2""",
        "streak_manifest": f"""WITH {_BOXES}, {_SAMPLE}, {_STREAK}, n AS (SELECT count(*) AS n_images, count(*) FILTER (stem IN (SELECT image_id FROM t)) AS n_with_detections, (SELECT count(DISTINCT image_id) FROM p WHERE image_id NOT IN (SELECT stem FROM i)) AS n_foreign FROM i)
          SELECT n_images, n_with_detections, n_images - n_with_detections AS n_empty, n_foreign, CASE WHEN n_with_detections = 0 THEN 'no image has a box' WHEN n_with_detections < 0.05 * n_images THEN 'few images have boxes' ELSE '' END AS warning, 'conf,x,y,w,h' AS box_order FROM n""",
        "streak_foreign_images": f"WITH {_BOXES}, {_SAMPLE} SELECT count(DISTINCT image_id) AS n_foreign FROM p WHERE image_id NOT IN (SELECT stem FROM i)",
        "coco_results": f"WITH {_BOXES} SELECT image_id, class_id AS category_id, round(x, 2) AS x, round(y, 2) AS y, round(w, 2) AS w, round(h, 2) AS h, round(score, 6) AS score FROM p WHERE score >= 0.9",
        "yolo_labels": f"WITH {_BOXES} SELECT image_id, string_agg(class_id || printf(' %.6f %.6f %.6f %.6f', (x + w / 2) / 1000, (y + h / 2) / 800, w / 1000, h / 800), chr(10) ORDER BY gt_id) AS label FROM g GROUP BY 1",
        "coco_summary": f"""WITH {_BOXES}, i AS (SELECT image_id, count(*) AS n FROM g GROUP BY 1) SELECT count(*) AS n_images, min(n) AS min_boxes, floor(quantile_cont(n, 0.5))::BIGINT AS median_boxes, max(n) AS max_boxes, (SELECT count(*) FROM g) AS n_boxes,
          (SELECT count(*) FROM g WHERE least(w, h) > 0 AND greatest(w, h) >= 5 * least(w, h)) AS n_elongated FROM i""",
        "coco_class_distribution": f"WITH {_BOXES} SELECT class_id, count(*) AS n FROM g GROUP BY 1",
        "grid_canonical_hash": f"SELECT vec_id, least({', '.join(_grid_hash(p) for p in images.orientations(8))}) AS hash FROM embeddings WHERE len(embedding) = 64",
        "near_dup_clusters": "SELECT md5(text) AS hash, count(*) AS size, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS members FROM documents GROUP BY 1 HAVING count(*) > 1",
        "hash_entropy": """WITH s AS (SELECT count(*)::DOUBLE AS n FROM documents GROUP BY md5(text)), t AS (SELECT sum(n) AS n, count(*) AS k, max(n) AS m FROM s), e AS (SELECT sum(-(s.n / t.n) * log2(s.n / t.n)) / log2(any_value(k)) AS h FROM s CROSS JOIN t)
          SELECT n::BIGINT AS n, k AS n_distinct, m::BIGINT AS largest, round(h, 6) AS entropy, k <= greatest(2, floor(n / 50)) OR m > 0.5 * n OR h < 0.3 AS collapsed FROM t CROSS JOIN e""",
        "group_key_candidates": _candidates(),
        "group_components": f"WITH RECURSIVE {_GROUPS} SELECT item, component FROM comp",
        "group_size_summary": f"""WITH RECURSIVE {_GROUPS}, s AS (SELECT count(*) AS n FROM comp GROUP BY component), r AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i FROM s)
          SELECT sum(n)::BIGINT AS n_items, count(*) AS n_groups, min(n) AS min_size, max(n) AS max_size, (SELECT n FROM r WHERE i = (SELECT count(*) FROM s) // 2) AS median_size, count(*) >= 0.95 * sum(n) AS per_item_like FROM s""",
        "spanning_clusters": "SELECT md5(text) AS cluster, count(DISTINCT doc_id // 3) AS n_groups FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id // 3) > 1",
        "submission_columns": f"WITH {_SUBMISSION} SELECT * FROM cols",
        "submission_id_errors": f"WITH {_SUBMISSION} SELECT 'repeated' AS problem, id FROM rep UNION ALL SELECT 'missing', id FROM mis UNION ALL SELECT 'extra', id FROM ext",
        "submission_check": f"""WITH {_SUBMISSION} SELECT 'INVALID' AS status, (SELECT count(*) FROM s) AS n_rows, (SELECT count(*) FROM e) AS n_expected, (SELECT count(*) FROM rep) AS n_repeated, (SELECT count(*) FROM mis) AS n_missing_ids, (SELECT count(*) FROM ext) AS n_extra_ids,
          (SELECT sum(n_missing) FROM cols)::BIGINT AS n_empty_cells, (SELECT count(*) FROM cols WHERE expects_number AND n_text > 0) AS n_wrong_kind, (SELECT count(*) FROM cols WHERE constant) AS n_constant, 0::BIGINT AS n_ragged, false AS order_differs,
          (SELECT string_agg(id, ',' ORDER BY line) FROM (SELECT * FROM rep ORDER BY line LIMIT 5)) AS repeated""",
        "scalar_functions": """SELECT o_orderkey, o_orderpriority || '.x' AS stem, printf('%.2f', o_totalprice / 8) AS text, nullif(regexp_extract(o_orderpriority, '^(\\d)-', 1), '') AS level, 'b.c/' || o_orderpriority || '.x.' || o_orderkey AS agent,
          date_diff('day', DATE '1999-01-01', o_orderdate::DATE)::INT AS days FROM orders""",
        "match_outcomes": f"WITH {_MATCHES} SELECT match_id, slot, agent, outcome FROM mo",
        "win_rates": f"""WITH {_MATCHES}, r AS (SELECT *, wins / (wins + draws + losses) AS w FROM wr) SELECT agent, played, wins, draws, losses, invalid, round(w, 6) AS win_rate, round(invalid / played, 6) AS invalid_rate, CASE WHEN invalid = 0 THEN 'PASS' ELSE 'FAIL' END AS health,
          CASE WHEN invalid > 0 THEN 'fix_health_first' WHEN w >= 0.65 THEN 'scripted_sufficient' WHEN w >= 0.55 THEN 'iterate_heuristic_or_search' ELSE 'weak_vs_random_fix_first' END AS recommendation FROM r""",
        "win_matrix": f"WITH {_MATCHES} SELECT * FROM wm",
        "matchup_shares": f"WITH {_MATCHES} SELECT agent, opponent, wins, losses, round(share, 6) AS share FROM ms",
        "ladder_profile": f"""WITH {_MATCHES}, x AS (SELECT agent, arg_min(opponent, share) AS weakest, min(share) AS ws, arg_max(opponent, share) AS strongest, max(share) AS ss FROM (SELECT * FROM ms ORDER BY opponent) GROUP BY 1)
          SELECT agent, weakest, round(ws, 6) AS weakest_share, strongest, round(ss, 6) AS strongest_share, round(invalid / played, 6) AS invalid_rate,
          array_to_string(list_filter([CASE WHEN invalid > 0 THEN 'fix_legality_first' END, CASE WHEN ws < 0.45 THEN 'target_weak_matchup' END, CASE WHEN invalid > 0 THEN NULL WHEN w >= 0.65 THEN 'weigh_rl_cost' WHEN w >= 0.55 THEN 'iterate_or_search' WHEN w IS NOT NULL THEN 'fix_heuristic_first' END,
            CASE WHEN invalid = 0 AND w IS NULL AND NOT coalesce(ws < 0.45, false) THEN 'iterate' END], lambda v: v IS NOT NULL), ',') AS hypotheses FROM x JOIN (SELECT *, wins / (wins + draws + losses) AS w FROM wr) USING (agent)""",
        "elo_ladder": _elo(),
        "ladder_lineups": f"""WITH {_MATCHES}, a AS (SELECT DISTINCT agent FROM m), g AS (SELECT x.agent AS a, y.agent AS b, unnest(range(1, 6)) AS n FROM a x JOIN a y ON x.agent < y.agent)
          SELECT row_number() OVER (ORDER BY md5('42:' || a || '|' || b || '|' || n)) - 1 AS seq, a, b FROM g""",
        "competition_check": _competition(),
        "readiness_score": _readiness(),
        "experiment_log_latest": """SELECT run_id, timestamp, model_family FROM (SELECT 'r' || lpad(o_orderkey::VARCHAR, 9, '0') AS run_id, strftime(o_orderdate, '%Y-%m-%d') AS timestamp, o_orderpriority AS model_family,
          row_number() OVER (PARTITION BY o_orderpriority ORDER BY strftime(o_orderdate, '%Y-%m-%d') DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1""",
    }
