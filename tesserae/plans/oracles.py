"""DuckDB SQL that gives the rows of the queries."""

from __future__ import annotations

from ..functions.color import lab_sql
from ..sources.rasters import VECTOR_PIXELS_SQL, VECTOR_RGB_SQL, formula_sql
from .queries import PALETTE

_L = lab_sql("r", "g", "b")
_PALETTE = ", ".join(f"({k}, {r}, {g}, {b})" for k, (r, g, b) in enumerate(PALETTE))
LABELLED = f"""px AS ({VECTOR_RGB_SQL}),
lab AS (SELECT *, {_L[0]} AS l1, {_L[1]} AS l2, {_L[2]} AS l3 FROM px),
pal AS (SELECT k, {_L[0]} AS p1, {_L[1]} AS p2, {_L[2]} AS p3 FROM (VALUES {_PALETTE}) t(k, r, g, b)),
lb AS (SELECT image_id, y, x, r, g, b, alpha, CAST(arg_min(k, ((l1-p1)*(l1-p1)+(l2-p2)*(l2-p2)+(l3-p3)*(l3-p3), k)) AS INT) AS label
  FROM lab, pal GROUP BY image_id, y, x, r, g, b, alpha)"""
FORMULA = f"lb AS ({formula_sql()})"
VALUES = f"v AS ({VECTOR_PIXELS_SQL})"
PROFILE = """SELECT image_id, label, count(*) AS pixels, min(x) AS x0, max(x) + 1 AS x1, min(y) AS y0, max(y) + 1 AS y1,
round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY image_id) AS DOUBLE), 6) AS fraction
FROM lb WHERE label >= 0 GROUP BY image_id, label"""
BORDER_CTE = """bo AS (SELECT image_id, least(p, q) AS a, greatest(p, q) AS b, count(*) AS length FROM (
  SELECT image_id, label AS p, lead(label) OVER (PARTITION BY image_id, y ORDER BY x) AS q FROM lb
  UNION ALL SELECT image_id, label, lead(label) OVER (PARTITION BY image_id, x ORDER BY y) FROM lb)
  WHERE p <> q GROUP BY 1, 2, 3)"""
DEGREES = "SELECT image_id, label, CAST(sum(length) AS BIGINT) AS degree FROM (SELECT image_id, a AS label, length FROM bo UNION ALL SELECT image_id, b, length FROM bo) GROUP BY 1, 2"
PATHS = "p AS (SELECT user_id, n AS pos, CAST(n AS DOUBLE) AS x, value AS y FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events))"
SETS = "s AS (SELECT vec_id AS id, label, CAST(embedding[1] AS DOUBLE) * 100 AS x, CAST(embedding[2] AS DOUBLE) * 100 AS y FROM embeddings)"
NEAR = "nn AS (SELECT a.id, min(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))) AS d FROM s a, s b WHERE a.label = 0 AND b.label = 1 GROUP BY a.id)"
LINES = "n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS idx FROM lineitem)"
FOLD = f"""{LINES}, l AS (SELECT l_orderkey, idx, l_discount + 0.5 AS a, l_tax AS c FROM n),
w AS (SELECT i.l_orderkey, i.idx, i.a, i.c, i.a * coalesce(product(1 - j.a), 1) AS weight FROM l i
  LEFT JOIN l j ON i.l_orderkey = j.l_orderkey AND j.idx > i.idx GROUP BY 1, 2, 3, 4)"""


def _box(value: str, table: str) -> str:
    """3x3 mean with the border repeated, x then y."""
    row = f"SELECT image_id, y, x, (coalesce(lag({value}) OVER wx, {value}) + {value} + coalesce(lead({value}) OVER wx, {value})) / 3.0 AS {value} FROM {table} WINDOW wx AS (PARTITION BY image_id, y ORDER BY x)"
    return f"SELECT image_id, y, x, (coalesce(lag({value}) OVER wy, {value}) + {value} + coalesce(lead({value}) OVER wy, {value})) / 3.0 AS {value} FROM ({row}) WINDOW wy AS (PARTITION BY image_id, x ORDER BY y)"


def _frame(kind: str, table: str) -> str:
    row = f"SELECT image_id, y, x, {kind}(mask) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS mask FROM ({table})"
    return f"SELECT image_id, y, x, {kind}(mask) OVER (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS mask FROM ({row})"


_MASK = "SELECT image_id, y, x, CAST(value > 0 AS INT) AS mask FROM v"
_CLIP = "least(greatest({}, 0.0), 1.0)".format


def _components(table: str) -> str:
    """CTEs up to ``cc`` (image_id, y, x, root): 4-connected pixels of ``table`` (image_id, y, x, v) with v >= 0; root is the place of the first one."""
    return f"""st AS (SELECT *, CAST(v IS DISTINCT FROM lag(v) OVER w OR lag(x) OVER w IS DISTINCT FROM x - 1 AS INT) AS s FROM {table} WINDOW w AS (PARTITION BY image_id, y ORDER BY x)),
rn AS (SELECT *, max(CASE WHEN s = 1 THEN y * 100000 + x END) OVER (PARTITION BY image_id, y ORDER BY x) AS run FROM st WHERE v >= 0),
ed AS (SELECT DISTINCT a.image_id, a.run AS p, b.run AS q FROM rn a JOIN rn b ON b.image_id = a.image_id AND b.y = a.y + 1 AND b.x = a.x AND b.v = a.v),
bd AS (SELECT * FROM ed UNION ALL SELECT image_id, q, p FROM ed),
rc(image_id, run, seen) AS (SELECT DISTINCT image_id, run, run FROM rn UNION SELECT rc.image_id, rc.run, bd.q FROM rc JOIN bd ON bd.image_id = rc.image_id AND bd.p = rc.seen),
rt AS (SELECT image_id, run, min(seen) AS root FROM rc GROUP BY 1, 2), cc AS (SELECT rn.image_id, rn.y, rn.x, root FROM rn JOIN rt USING (image_id, run))"""


ORACLE_SQL: dict[str, str] = {
    "region_profile": f"WITH {LABELLED} {PROFILE}",
    "region_borders": f"WITH {LABELLED}, {BORDER_CTE} SELECT * FROM bo",
    "region_degrees": f"WITH {LABELLED}, {BORDER_CTE} {DEGREES}",
    "formula_profile": f"WITH {FORMULA} {PROFILE}",
    "formula_borders": f"WITH {FORMULA}, {BORDER_CTE} SELECT * FROM bo",
    "colour_lab": f"WITH px AS ({VECTOR_RGB_SQL}) SELECT y, x, round({_L[0]}, 5) AS lab_l, round({_L[1]}, 5) AS lab_a, round({_L[2]}, 5) AS lab_b FROM px",
    "colour_roundtrip": "SELECT count(*) * 21 AS pixels, count(*) * 21 AS same FROM embeddings",
    "colour_hex": f"WITH px AS ({VECTOR_RGB_SQL}) SELECT printf('#%02X%02X%02X', r, g, b) AS hex, count(*) AS n, r FROM px GROUP BY r, g, b",
    "colour_histogram": f"WITH px AS ({VECTOR_RGB_SQL}) SELECT image_id, CAST(r // 32 * 1024 + g // 32 * 32 + b // 32 AS BIGINT) AS key, count(*) AS n FROM px GROUP BY 1, 2",
    "colour_stats": f"""WITH px AS ({VECTOR_RGB_SQL}), h AS (SELECT r // 32 * 1024 + g // 32 * 32 + b // 32 AS key, count(*) AS n FROM px GROUP BY 1),
t AS (SELECT count(*) AS colours, max(n) AS c1, (SELECT n FROM h ORDER BY n DESC, key LIMIT 1 OFFSET 1) AS c2 FROM h),
g AS (SELECT greatest(abs(grey - coalesce(lag(grey) OVER (PARTITION BY y ORDER BY x), grey)), abs(grey - coalesce(lag(grey) OVER (PARTITION BY x ORDER BY y), grey))) AS e
  FROM (SELECT y, x, (r + g + b) / 3.0 AS grey FROM px)),
c AS (SELECT greatest(quantile_cont(e, 0.7), 4.0) AS cut FROM g)
SELECT 'emb' AS image_id, colours, round(c1 / CAST(greatest(coalesce(c2, c1), 1) AS DOUBLE), 6) AS peak_ratio, (SELECT round(avg(CAST(e >= cut AS DOUBLE)), 6) FROM g, c) AS grad_frac FROM t""",
    "palette": f"""WITH {LABELLED}, n AS (SELECT label, count(*) AS n FROM lb GROUP BY 1)
SELECT 'emb' AS image_id, label, printf('#%02X%02X%02X', r, g, b) AS hex, round(n / CAST(sum(n) OVER () AS DOUBLE), 6) AS fraction, CAST(row_number() OVER (ORDER BY n DESC, label) - 1 AS INT) AS rank
FROM n JOIN (VALUES {_PALETTE}) t(k, r, g, b) ON label = k""",
    "label_ratios": "SELECT 'emb' AS image_id, count(*) * 21 AS subject, 0.0::DOUBLE AS gap_frac, 0.0::DOUBLE AS soft_frac FROM embeddings",
    "gradient": f"""WITH {VALUES}, g AS (SELECT y, greatest(abs(value - coalesce(lag(value) OVER (PARTITION BY y ORDER BY x), value)), abs(value - coalesce(lag(value) OVER (PARTITION BY x ORDER BY y), value))) AS e FROM v)
SELECT y, round(avg(e), 6) AS mean, round(max(e), 6) AS top, round(quantile_cont(e, 0.9), 6) AS p90 FROM g GROUP BY y""",
    "visible_boundary": f"""WITH px AS ({VECTOR_RGB_SQL}), j AS (SELECT y, greatest({', '.join(f"abs(coalesce(lead({c}) OVER (PARTITION BY {p} ORDER BY {o}), {c}) - {c})" for c in 'rgb' for p, o in (('y', 'x'), ('x', 'y')))}) AS jump FROM px)
SELECT y, count_if(jump > 28) AS boundary, max(jump) AS jump FROM j GROUP BY y""",
    "morphology": f"WITH {VALUES} SELECT y, CAST(sum(mask) AS BIGINT) AS kept FROM ({_frame('max', _frame('min', _frame('min', _frame('max', _MASK))))}) GROUP BY y",
    "soft_sdf": f"WITH {FORMULA}, m AS (SELECT image_id, y, x, CAST(label >= 0 AS DOUBLE) AS sdf FROM lb), b1 AS ({_box('sdf', 'm')}), b2 AS ({_box('sdf', 'b1')}) SELECT image_id, y, x, round((0.5 - sdf) * 16.0 * sqrt(2 / 12.0), 6) AS sdf FROM b2",
    "laplacian": f"""WITH {VALUES}, w AS (SELECT y, value,
  coalesce(lag(value) OVER ox, last_value(value) OVER ax) AS l, coalesce(lead(value) OVER ox, first_value(value) OVER ax) AS r,
  coalesce(lag(value) OVER oy, last_value(value) OVER ay) AS u, coalesce(lead(value) OVER oy, first_value(value) OVER ay) AS n FROM v
  WINDOW ox AS (PARTITION BY y ORDER BY x), oy AS (PARTITION BY x ORDER BY y), ax AS (PARTITION BY y ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING),
  ay AS (PARTITION BY x ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT y, round(sum(abs(l + r + u + n - 4 * value)), 6) AS energy FROM w GROUP BY y""",
    "downsample": f"WITH {VALUES} SELECT image_id, CAST(y // 4 AS INT) AS y, CAST(x // 4 AS INT) AS x, round(avg(value), 6) AS value FROM v GROUP BY 1, 2, 3",
    "dual_edges": f"""WITH {FORMULA}, {BORDER_CTE}, d AS (SELECT image_id, max(x) AS w, max(y) AS h FROM lb GROUP BY 1),
f AS (SELECT lb.image_id, -1 AS a, label AS b, CAST(sum(CAST(x = 0 AS INT) + CAST(y = 0 AS INT) + CAST(x = w AS INT) + CAST(y = h AS INT)) AS BIGINT) AS length FROM lb JOIN d USING (image_id) WHERE label >= 0 GROUP BY 1, 2, 3)
SELECT image_id, a, b, CAST(sum(length) AS BIGINT) AS length FROM (SELECT * FROM bo UNION ALL SELECT * FROM f WHERE length > 0) GROUP BY 1, 2, 3""",
    "lloyd_step": """WITH e AS (SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) t(i)), c AS (SELECT label, i, avg(v) AS m FROM e GROUP BY 1, 2),
d AS (SELECT e.vec_id, c.label, sqrt(sum((v - m) * (v - m))) AS d FROM e JOIN c USING (i) GROUP BY 1, 2)
SELECT vec_id, arg_min(label, (d, label)) AS cluster, round(min(d), 6) AS distance FROM d GROUP BY 1""",
    "recall_topk": """WITH e AS (SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) t(i)), c AS (SELECT label, i, avg(v) AS m, count(*) AS n FROM e GROUP BY 1, 2),
d AS (SELECT e.vec_id, c.label AS cluster, exp(-sqrt(sum((v - m) * (v - m)))) + exp(-0.25 * abs(ln(max(n)) - 3.0)) AS score FROM e JOIN c USING (i) GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, cluster) AS INT) AS rank FROM d)
SELECT vec_id, cluster, rank, round(score, 6) AS score FROM r WHERE rank <= 3""",
    "chamfer": f"WITH {SETS}, {NEAR}, mm AS (SELECT b.id, min(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))) AS d FROM s a, s b WHERE a.label = 0 AND b.label = 1 GROUP BY b.id) SELECT 'emb' AS image_id, round(0.5 * ((SELECT avg(d) FROM nn) + (SELECT avg(d) FROM mm)), 6) AS chamfer",
    "seam_p95": f"WITH {SETS}, {NEAR} SELECT 'emb' AS image_id, round(quantile_cont(d, 0.95), 6) AS seam_p95 FROM nn",
    "uncovered": f"WITH {SETS}, {NEAR}, c AS (SELECT count_if(d > 3) AS far, count(*) AS n FROM nn), r AS (SELECT *, row_number() OVER (ORDER BY d DESC, id) AS rank FROM nn, c) SELECT 'emb' AS image_id, id, round(d, 6) AS d FROM r WHERE CASE WHEN far >= 4 THEN d > 3 ELSE rank <= greatest(4, least(n, 24)) END",
    "coverage": """WITH m AS (SELECT lang, doc_id, quality, toxic FROM labels JOIN documents USING (doc_id)), c AS (SELECT lang, count(DISTINCT doc_id) FILTER (WHERE quality = 1) AS t,
count(DISTINCT doc_id) FILTER (WHERE toxic = 0) AS u, count(DISTINCT doc_id) FILTER (WHERE quality = 1 AND toxic = 0) AS b FROM m WHERE quality = 1 OR toxic = 0 GROUP BY 1)
SELECT lang, round(b / CAST(greatest(t, 1) AS DOUBLE), 6) AS cover, round((u - b) / CAST(greatest(u, 1) AS DOUBLE), 6) AS leak, round(b / CAST(greatest(t + u - b, 1) AS DOUBLE), 6) AS iou FROM c""",
    "missing_keys": "SELECT DISTINCT doc_id AS missing FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "allow_list": "SELECT c_nationkey, count(*) AS n FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey <= 2) GROUP BY 1",
    "role_runs": """WITH c AS (SELECT *, CAST(lower(role) IS DISTINCT FROM lag(lower(role)) OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS g FROM conversations),
r AS (SELECT *, sum(g) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS run FROM c)
SELECT conv_id, CAST(run AS BIGINT) AS run, arg_min(role, turn) AS role, min(turn) AS first, max(turn) AS last, count(*) AS n FROM r GROUP BY 1, 2""",
    "type_runs": """WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
c AS (SELECT *, CAST(lower(event_type) IS DISTINCT FROM lag(lower(event_type)) OVER (PARTITION BY user_id ORDER BY k) AS INT) AS g FROM e),
r AS (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY k) - 1 AS run FROM c)
SELECT user_id, CAST(run AS BIGINT) AS run, arg_min(event_type, k) AS event_type, min(k) AS first, max(k) AS last, count(*) AS n FROM r GROUP BY 1, 2""",
    "majority_type": "WITH c AS (SELECT user_id, event_type, count(*) AS n, min((ts, event_id)) AS seen FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, seen) AS k FROM c) SELECT user_id, event_type, n FROM r WHERE k = 1",
    "arc_length": f"WITH {PATHS}, g AS (SELECT user_id, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS seg FROM p WINDOW w AS (PARTITION BY user_id ORDER BY pos)) SELECT user_id, round(coalesce(sum(seg), 0.0), 6) AS arc, count(*) AS n FROM g GROUP BY 1",
    "resample": f"""WITH {PATHS}, g AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0.0) AS seg FROM p WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
a AS (SELECT *, sum(seg) OVER (PARTITION BY user_id ORDER BY pos) AS arc FROM g),
b AS (SELECT user_id, pos, arc AS arc1, x AS x1, y AS y1, lag(arc) OVER w AS arc0, lag(x) OVER w AS x0, lag(y) OVER w AS y0, max(arc) OVER (PARTITION BY user_id) AS total, lead(pos) OVER w IS NULL AS ends FROM a WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
k AS (SELECT b.*, k FROM b, range(0, 8) t(k) WHERE CASE WHEN arc0 IS NULL THEN k = 0 ELSE total > 0 AND k >= floor(arc0 / (total / 7)) + 1 AND k <= CASE WHEN ends THEN 7 ELSE floor(arc1 / (total / 7)) END END),
t AS (SELECT *, CASE WHEN arc0 IS NULL OR arc1 <= arc0 THEN 0 ELSE least(greatest((k * (total / 7) - arc0) / (arc1 - arc0), 0), 1) END AS f FROM k)
SELECT user_id, CAST(k AS INT) AS k, round(CASE WHEN arc0 IS NULL THEN x1 ELSE x0 + f * (x1 - x0) END, 5) AS x, round(CASE WHEN arc0 IS NULL THEN y1 ELSE y0 + f * (y1 - y0) END, 5) AS y FROM t""",
    "shoelace": f"""WITH {PATHS}, q AS (SELECT user_id, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM p WINDOW w AS (PARTITION BY user_id ORDER BY pos))
SELECT user_id, round(sum(0.5 * (x * ny - nx * y)), 6) AS area, round(sum(sqrt((nx-x)*(nx-x)+(ny-y)*(ny-y))), 6) AS perimeter, count(*) AS n FROM q GROUP BY 1""",
    "turn_histogram": f"""WITH {PATHS}, q AS (SELECT user_id, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny,
coalesce(lag(x) OVER w, last_value(x) OVER z) AS bx, coalesce(lag(y) OVER w, last_value(y) OVER z) AS b_y FROM p WINDOW w AS (PARTITION BY user_id ORDER BY pos), z AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
a AS (SELECT atan2(ny - y, nx - x) - atan2(y - b_y, x - bx) + pi() AS t FROM q), m AS (SELECT t - 2 * pi() * floor(t / (2 * pi())) - pi() AS t FROM a),
h AS (SELECT CAST(least(floor((t + pi()) / (2 * pi() / 24)) + 1, 24) AS INT) AS bin, count(*) AS n FROM m GROUP BY 1)
SELECT bin, n, round(n / CAST(sum(n) OVER () AS DOUBLE), 6) AS share FROM h""",
    "subsample": f"WITH {PATHS}, n AS (SELECT user_id, count(*) AS n FROM p GROUP BY 1), w AS (SELECT DISTINCT user_id, floor(i * (n - 1) / 4.0) + 1 AS pos FROM n, range(0, 5) t(i) WHERE n > 5) SELECT p.user_id, CAST(p.pos AS INT) AS pos FROM p JOIN n USING (user_id) LEFT JOIN w ON w.user_id = p.user_id AND w.pos = p.pos WHERE n <= 5 OR w.pos IS NOT NULL",
    "point_in_ring": """WITH r(pos, x, y) AS (VALUES (0, 0.1::DOUBLE, 0.1::DOUBLE), (1, 9.1, 1.1), (2, 5.1, 4.1), (3, 8.1, 9.1), (4, 1.1, 7.1)), s AS (SELECT a.x, a.y, b.x AS nx, b.y AS ny FROM r a JOIN r b ON b.pos = (a.pos + 1) % 5),
e AS (SELECT event_id AS id, (event_id % 40) / 4.0 AS px, (CAST(floor(value) AS BIGINT) % 40) / 4.0 AS py FROM events)
SELECT id, count_if((y > py) <> (ny > py) AND px < (nx - x) * (py - y) / (ny - y) + x) % 2 = 1 AS inside FROM e, s GROUP BY id""",
    "principal_axis": """WITH m AS (SELECT l_returnflag, avg(l_quantity) AS mx, avg(l_discount) AS my, var_pop(l_quantity) AS vx, var_pop(l_discount) AS vy, covar_pop(l_quantity, l_discount) AS c FROM lineitem GROUP BY 1),
h AS (SELECT *, sqrt(pow((vx - vy) / 2, 2) + c * c) AS half FROM m)
SELECT l_returnflag, round(mx, 4) AS mx, round(my, 4) AS my, round((vx + vy) / 2 + half, 4) AS major, round(greatest((vx + vy) / 2 - half, 0.0), 4) AS minor, round(0.5 * atan2(2 * c, vx - vy), 4) + 0.0 AS angle FROM h""",
    "spread": "SELECT o_orderpriority, round(stddev_pop(o_totalprice), 3) AS pop, round(stddev_samp(o_totalprice), 3) AS samp, round(quantile_cont(o_totalprice, 0.7), 3) AS p70, round(median(o_totalprice), 3) AS median FROM orders GROUP BY 1",
    "weighted_error": "SELECT l_linestatus, round(sum(l_quantity * l_discount) / (sum(l_quantity) + 1e-8), 8) AS error FROM lineitem GROUP BY 1",
    "painter_fold": f"WITH {FOLD} SELECT l_orderkey, round(sum(c * weight) + 1.234e-7, 6) AS c, round(sum(weight) + 1.234e-7, 6) AS alpha FROM w GROUP BY 1",
    "leave_one_out": f"""WITH {FOLD}, h AS (SELECT l_orderkey, idx AS held FROM l),
o AS (SELECT h.l_orderkey, h.held, i.idx, i.c, i.a * coalesce(product(1 - j.a), 1) AS weight FROM h JOIN l i ON i.l_orderkey = h.l_orderkey AND i.idx <> h.held
  LEFT JOIN l j ON j.l_orderkey = h.l_orderkey AND j.idx > i.idx AND j.idx <> h.held GROUP BY h.l_orderkey, h.held, i.idx, i.c, i.a),
s AS (SELECT l_orderkey, held, sum(c * weight) AS c, sum(weight) AS alpha FROM o GROUP BY 1, 2), f AS (SELECT l_orderkey, sum(c * weight) AS c, sum(weight) AS alpha FROM w GROUP BY 1)
SELECT h.l_orderkey, h.held AS idx, round(abs(f.c - coalesce(s.c, 0)) + 1.234e-7, 6) AS d_rgb, round(abs(f.alpha - coalesce(s.alpha, 0)) + 1.234e-7, 6) AS d_alpha
FROM h JOIN f USING (l_orderkey) LEFT JOIN s ON s.l_orderkey = h.l_orderkey AND s.held = h.held""",
    "budget_limit": f"WITH {LINES} SELECT * FROM (SELECT l_orderkey, idx, l_quantity, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY idx) AS running FROM n) WHERE running <= 60",
    "props_json": "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, '{\"k\":' || CAST(json_extract(props, '$.k') AS INT) || '}' AS body FROM events",
    "hex_normalise": r"""WITH w AS (SELECT unnest(regexp_split_to_array(text, '[ \n\t]+')) AS raw FROM documents),
r AS (SELECT raw FROM w WHERE regexp_full_match(raw, '#?[0-9A-Fa-f]{3,6}') UNION ALL SELECT '#' || md5(props)[1:3] FROM events), c AS (SELECT raw, count(*) AS n FROM r GROUP BY 1),
b AS (SELECT *, upper(ltrim(trim(raw, ' '), '#')) AS bare FROM c), f AS (SELECT *, '#' || CASE WHEN length(bare) = 3 THEN bare[1] || bare[1] || bare[2] || bare[2] || bare[3] || bare[3] ELSE bare END AS hex FROM b)
SELECT raw, CASE WHEN regexp_full_match(hex, '#[0-9A-F]{6}') THEN hex END AS hex, n FROM f""",
    "angles": """WITH e AS (SELECT event_id, CAST(event_id % 720 - 360 AS DOUBLE) AS a FROM events), f AS (SELECT *, a - 180 * floor(a / 180) AS m FROM e),
g AS (SELECT event_id, arg_min(t, (abs((a - t + 180) - 360 * floor((a - t + 180) / 360) - 180), k)) AS near FROM f, (VALUES (0, 0.0::DOUBLE), (1, 30.0), (2, 45.0), (3, 90.0), (4, 180.0)) v(k, t) GROUP BY 1)
SELECT event_id, CASE WHEN m >= 135 THEN 0.0::DOUBLE WHEN m >= 45 THEN 90.0 ELSE 0.0 END AS square, near FROM f JOIN g USING (event_id)""",
    "canvas_points": """WITH e AS (SELECT event_id, radians(event_id % 360) AS t, CASE WHEN event_id % 2 = 1 THEN -0.5 ELSE 0.5 END * 40.0 AS sx, -0.25 * 20.0 AS sy FROM events)
SELECT event_id, round(160 + cos(t) * sx - sin(t) * sy, 6) AS x, round(100 + sin(t) * sx + cos(t) * sy, 6) AS y FROM e""",
    "score_formulas": f"""WITH p AS (SELECT p_partkey, p_size / 50.0::DOUBLE AS u, p_retailprice / 2000.0::DOUBLE AS v, p_partkey % 5 AS h, p_partkey % 41 AS n FROM part),
s AS (SELECT *, u * v * (0.55 + 0.45 * exp(-0.8 * n / 40.0)) AS overall, least(greatest(0.1 + 4 * v, 0.02), 50) AS ar FROM p)
SELECT p_partkey,
round({_CLIP(f"0.40 * (1 - least(u, 1)) + 0.25 * least(h / 4.0, 1) + 0.15 * {_CLIP('ln(1 + v * 3) / ln(6)')} + 0.15 * {_CLIP('4 * v / 8')} + 0.025 * least(greatest(1 - 2 * abs(u - 0.55), 0), 0.5)")}, 8) AS complexity,
round({_CLIP(f"0.45 * least(u, 1) + 0.30 * v + 0.15 * (1 - {_CLIP('ln(1 + v * 3) / ln(4)')}) + 0.10 * {_CLIP('8 * u / 10')}")}, 8) AS simplicity,
round(exp(-0.8 * n / 40.0), 8) AS layers,
round(0.50 * exp(-v * 20 / 12) + 0.28 * u + 0.18 * u * v - 0.40 * (1 - u) + 0.03 * ln(least(greatest(ar, 0.2), 4)) - 0.55 * (1 - u) * least(greatest(ln(greatest(ar, 1)), 0), 4) - 0.25 * (1 - u) * (1 - u), 8) AS pose,
round(0.30 * u + 0.35 * {_CLIP('1 - v * 60 / 55')} + 0.25 * (1 - v) + 0.10 * u, 8) AS similarity,
round(CASE WHEN v < 0.60 THEN least(overall, 0.35) ELSE overall END, 8) AS final FROM s""",
    "depth_order": f"""WITH {LABELLED}, {BORDER_CTE}, dg AS ({DEGREES}), f AS (SELECT label, count(*) AS n, avg(x) AS cx, avg(y) AS cy FROM lb GROUP BY 1),
rd AS (SELECT *, CAST(floor(cx + 0.5) AS INT) AS rx, CAST(floor(cy + 0.5) AS INT) AS ry FROM f), h AS (SELECT max(y) + 1.0 AS h FROM lb),
en AS (SELECT rd.label, count(*) AS enc FROM rd JOIN lb ON lb.x = rx AND lb.y = ry AND lb.label <> rd.label JOIN f u ON u.label = lb.label AND u.n * 0.95 > rd.n GROUP BY 1),
sc AS (SELECT f.label, 0.45 * f.n / max(f.n) OVER () + 0.25 * coalesce(degree, 0) / greatest(max(coalesce(degree, 0)) OVER (), 1) + 0.15 * exp(-2.5 * (pow((cx - 10.5) / 21, 2) + pow((cy - h / 2) / h, 2))) + 0.15 / (1 + coalesce(enc, 0)) AS score
  FROM f CROSS JOIN h LEFT JOIN dg ON dg.label = f.label LEFT JOIN en ON en.label = f.label)
SELECT 'emb' AS image_id, label, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, label) - 1 AS INT) AS depth FROM sc""",
    "gap_round": f"""WITH {FORMULA}, o(k, dy, dx) AS (VALUES (0, -1, 0), (1, 1, 0), (2, 0, -1), (3, 0, 1)), c AS (SELECT p.image_id, p.y, p.x, q.label, count(*) AS n, min(k) AS k FROM lb p, o, lb q
WHERE p.label < 0 AND q.image_id = p.image_id AND q.y = p.y + dy AND q.x = p.x + dx AND q.label >= 0 GROUP BY 1, 2, 3, 4), b AS (SELECT image_id, y, x, arg_min(label, (-n, k)) AS label FROM c GROUP BY 1, 2, 3)
SELECT lb.image_id, CASE WHEN lb.label >= 0 THEN lb.label ELSE coalesce(b.label, -1) END AS label, count(*) AS n FROM lb LEFT JOIN b ON b.image_id = lb.image_id AND b.y = lb.y AND b.x = lb.x GROUP BY 1, 2""",
    "svg_sizes": "SELECT CAST(p_size AS DOUBLE) AS native_w, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size * 2 AS DOUBLE) ELSE 7.5 END AS native_h, count(*) AS n FROM part GROUP BY 1, 2",
    "layer_documents": """SELECT CASE WHEN l_linenumber = 2 THEN '#AABBCC' ELSE '#3A9FFA' END AS fill, CASE WHEN l_tax <= 0 OR l_quantity <= 0 THEN 'size is not positive' END AS problem, count(*) AS n, round(sum(l_quantity), 2) AS height FROM lineitem GROUP BY 1, 2""",
    "edge_roles": f"""WITH {FORMULA}, {BORDER_CTE}, ends AS (SELECT image_id, a AS label, length FROM bo WHERE a >= 0 AND b >= 0 UNION ALL SELECT image_id, b, length FROM bo WHERE a >= 0 AND b >= 0),
dg AS (SELECT image_id, label, sum(length) AS degree FROM ends GROUP BY 1, 2), f AS (SELECT image_id, label, count(*) AS n, avg(x) AS cx, avg(y) AS cy FROM lb WHERE label >= 0 GROUP BY 1, 2),
rd AS (SELECT f.*, u.label AS under FROM f LEFT JOIN lb u ON u.image_id = f.image_id AND u.x = floor(cx + 0.5) AND u.y = floor(cy + 0.5)),
en AS (SELECT rd.image_id, rd.label, count(*) AS enc FROM rd JOIN f u ON u.image_id = rd.image_id AND u.label = rd.under AND rd.under <> rd.label AND u.n * 0.95 > rd.n GROUP BY 1, 2),
sc AS (SELECT rd.*, 0.45 * n / max(n) OVER w + 0.25 * coalesce(degree, 0) / greatest(max(coalesce(degree, 0)) OVER w, 1) + 0.15 * exp(-2.5 * (pow((cx - 32) / 64, 2) + pow((cy - 32) / 64, 2))) + 0.15 / (1 + coalesce(enc, 0)) AS score
  FROM rd LEFT JOIN dg USING (image_id, label) LEFT JOIN en USING (image_id, label) WINDOW w AS (PARTITION BY rd.image_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, label) AS depth FROM sc),
e AS (SELECT bo.image_id, bo.a, bo.b, CASE WHEN p.depth > q.depth THEN p.under = q.label AND p.n < 0.95 * q.n ELSE q.under = p.label AND q.n < 0.95 * p.n END AS cut
  FROM bo LEFT JOIN o p ON p.image_id = bo.image_id AND p.label = bo.a LEFT JOIN o q ON q.image_id = bo.image_id AND q.label = bo.b)
SELECT image_id, a, b, CASE WHEN a >= 0 AND cut THEN 'OCCLUSION_CUT' ELSE 'SHAPE' END AS role FROM e""",
    "chamfer_huber": f"""WITH {SETS}, {NEAR}, mm AS (SELECT b.id, min(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))) AS d FROM s a, s b WHERE a.label = 0 AND b.label = 1 GROUP BY b.id)
SELECT 'emb' AS image_id, round((SELECT avg(CASE WHEN d < 8 THEN 0.5 * d * d / 8 ELSE d - 4 END) FROM nn) + (SELECT avg(CASE WHEN d < 8 THEN 0.5 * d * d / 8 ELSE d - 4 END) FROM mm), 6) AS chamfer""",
    "recall_formulas": """WITH p AS (SELECT p_partkey, p_partkey % 2 AS h, p_partkey % 3 AS w, p_partkey % 5 AS t, p_size / 50.0::DOUBLE AS u, p_retailprice / 2000.0::DOUBLE AS v FROM part)
SELECT p_partkey, round((u + v) * CASE WHEN t = 0 THEN 1.35 ELSE 1 END * CASE WHEN h > 0 AND w = 0 THEN 1.25 WHEN h > 0 AND w = 1 THEN 0.75 ELSE 1 END * exp(-2.2 * v * u)
  * CASE WHEN v > 0.55 AND u / 5 > 0.04 THEN exp(-abs(v - 0.75) * v) ELSE 1 END, 8) AS recall,
round(exp(-2.0 * abs(v - u)) + exp(-1.5 * abs(ln(greatest(1 + u, 1) + 1e-6) - ln(greatest(1 + 3 * v, 1) + 1e-6))) + exp(-3.0 * u * v) + 0.5 * v + CASE WHEN h = 0 THEN 0.4 ELSE 0 END, 8) AS plain FROM p""",
    "tag_overlap": "SELECT p_partkey FROM part WHERE list_has_any(string_split(p_name, ' '), ['ring', 'red'])",
    "order_flags": "SELECT l_orderkey, bool_or(l_returnflag = 'R') AS any_returned, bool_and(l_returnflag = 'R') AS all_returned, bool_or(l_quantity > 5) AS any_large, bool_and(l_quantity > 5) AS all_large FROM lineitem GROUP BY 1",
    "best_line": "SELECT l_partkey, l_discount, l_quantity, l_tax, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_discount, -l_quantity, l_tax, l_orderkey, l_linenumber, l_extendedprice) AS k FROM lineitem) WHERE k = 1",
    "random_sample": "SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('7:' || c_custkey), c_custkey) AS k FROM customer) WHERE k <= 3",
    "unique_concat": "WITH f AS (SELECT user_id, event_type, min((ts, event_id)) AS seen FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type, ',' ORDER BY seen) AS types FROM f GROUP BY 1",
    "largest_labels": f"WITH {LABELLED}, n AS (SELECT image_id, label, count(*) AS pixels FROM lb WHERE label >= 0 GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY pixels DESC, label) - 1 AS INT) AS place FROM n) SELECT * FROM r WHERE place < 4",
    "global_mode": f"WITH {FORMULA}, n AS (SELECT image_id, label, count(*) AS n FROM lb WHERE label >= 0 GROUP BY 1, 2) SELECT image_id, arg_min(label, (-n, label)) AS label, max(n) AS n FROM n GROUP BY 1",
    "polar_order": f"WITH {PATHS}, c AS (SELECT *, atan2(y - avg(y) OVER (PARTITION BY user_id), x - avg(x) OVER (PARTITION BY user_id)) AS angle FROM p) SELECT user_id, CAST(pos AS INT) AS pos, CAST(row_number() OVER (PARTITION BY user_id ORDER BY angle, pos) AS INT) AS place FROM c",
    "duplicate_rings": """WITH r AS (SELECT p_partkey AS ring, p_size * 4.0 AS cx, p_partkey % 97 AS cy, p_retailprice AS area FROM part)
SELECT 'p' AS image_id, b.ring, min(a.ring) AS first_ring FROM r a JOIN r b ON a.ring < b.ring AND sqrt((a.cx-b.cx)*(a.cx-b.cx)+(a.cy-b.cy)*(a.cy-b.cy)) <= 3
  AND (least(abs(a.area), abs(b.area)) < 1e-6 OR least(abs(a.area), abs(b.area)) / greatest(abs(a.area), abs(b.area)) >= 0.7) GROUP BY 1, 2""",
    "face_cap": f"""WITH {LABELLED}, {BORDER_CTE}, n AS (SELECT label, count(*) AS n FROM lb WHERE label >= 0 GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, label) AS place FROM n),
t AS (SELECT a AS label, b AS other, length FROM bo UNION ALL SELECT b, a, length FROM bo), v AS (SELECT t.label, arg_min(other, (-length, other)) AS other FROM t JOIN r k ON k.label = other AND k.place <= 4 GROUP BY 1),
m AS (SELECT r.label, CASE WHEN place <= 4 THEN r.label ELSE coalesce(v.other, (SELECT label FROM r WHERE place = 1)) END AS other FROM r LEFT JOIN v USING (label))
SELECT 'emb' AS image_id, m.other AS label, CAST(sum(n) AS BIGINT) AS n FROM n JOIN m USING (label) GROUP BY 1, 2""",
    "affine_sample": f"""WITH {VALUES}, k AS (SELECT cos(radians(30)) / 1.25 AS c, sin(radians(30)) / 1.25 AS s),
g AS (SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x, (x - 32) * c + (y - 32) * s + 31.5 AS u, (y - 32) * c - (x - 32) * s + 31.5 AS w FROM range(0, 64) a(y), range(0, 64) b(x), k),
t AS (SELECT y, x, CAST(floor(u) AS INT) + i AS tx, CAST(floor(w) AS INT) + j AS ty, CASE WHEN i = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END * CASE WHEN j = 1 THEN w - floor(w) ELSE 1 - (w - floor(w)) END AS f FROM g, (VALUES (0), (1)) p(i), (VALUES (0), (1)) q(j))
SELECT v.image_id, t.y, t.x, round(sum(f * value), 6) + 0.0 AS value FROM t JOIN v ON v.x = tx AND v.y = ty WHERE f > 0 GROUP BY 1, 2, 3""",
    "grey_composite": "WITH px AS (" + VECTOR_RGB_SQL + "), a AS (SELECT *, (x % 5) / 4.0 AS al FROM px) SELECT y, " + ", ".join(f"round(avg(least(greatest({c} * al + 128 * (1 - al), 0), 255)), 6) AS {c}" for c in "rgb") + " FROM a GROUP BY y",
    "median_filter": f"""WITH {VALUES}, m AS (SELECT p.y, p.x, list_sort(list(q.value)) AS l FROM v p JOIN v q ON q.y BETWEEN p.y - 1 AND p.y + 1 AND q.x BETWEEN p.x - 1 AND p.x + 1 GROUP BY 1, 2),
e AS (SELECT y, l[CAST(ceil(len(l) / 2.0) AS INT)] AS median FROM m) SELECT y, round(sum(median), 6) AS total, round(max(median), 6) AS top FROM e GROUP BY y""",
    "central_steps": f"""WITH {VALUES}, e AS (SELECT y, coalesce(lead(value) OVER wx - lag(value) OVER wx, 0) AS dx, coalesce(lead(value) OVER wy - lag(value) OVER wy, 0) AS dy FROM v WINDOW wx AS (PARTITION BY y ORDER BY x), wy AS (PARTITION BY x ORDER BY y))
SELECT y, round(sum(abs(dx)), 6) AS across, round(sum(abs(dy)), 6) AS down FROM e GROUP BY y""",
    "correlation": "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS corr FROM lineitem GROUP BY 1",
    "face_cycles": f"""WITH {LABELLED.replace('lb AS', 'lv AS')}, lf AS ({formula_sql()}), lb AS (SELECT image_id, y, x, label FROM lv UNION ALL SELECT image_id, y, x, label FROM lf),
n AS (SELECT image_id, label AS face, lag(label) OVER wy AS u, lead(label) OVER wy AS d, lag(label) OVER wx AS l, lead(label) OVER wx AS r, y, x, label FROM lb WINDOW wx AS (PARTITION BY image_id, y ORDER BY x), wy AS (PARTITION BY image_id, x ORDER BY y)),
q AS (SELECT *, lead(r) OVER (PARTITION BY image_id, x ORDER BY y) AS dr FROM n)
SELECT image_id, face, count(*) - count_if(r = face) - count_if(d = face) + count_if(r = face AND d = face AND dr = face) AS euler,
  count_if(u IS DISTINCT FROM face) + count_if(d IS DISTINCT FROM face) + count_if(l IS DISTINCT FROM face) + count_if(r IS DISTINCT FROM face) AS length, count(*) AS pixels
FROM q WHERE face >= 0 GROUP BY 1, 2""",
    "component_sizes": f"""WITH RECURSIVE {FORMULA}, t AS (SELECT image_id, y, x, label AS v FROM lb), {_components('t')}
SELECT image_id, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY root) - 1 AS INT) AS component, count(*) AS pixels, min(y) AS y0, min(x) AS x0 FROM cc GROUP BY image_id, root""",
    "vector_components": f"""WITH RECURSIVE {VALUES}, t AS (SELECT image_id, y, x, CASE WHEN value > 0.15 THEN 0 ELSE -1 END AS v FROM v), {_components('t')},
n AS (SELECT root, count(*) AS pixels FROM cc GROUP BY 1) SELECT pixels, count(*) AS components FROM n GROUP BY 1""",
    "hole_sizes": f"""WITH RECURSIVE {FORMULA}, t AS (SELECT image_id, y, x, CASE WHEN label = 0 THEN -1 ELSE 0 END AS v FROM lb), {_components('t')}, d AS (SELECT image_id, max(y) AS h, max(x) AS w FROM lb GROUP BY 1),
n AS (SELECT image_id, root, count(*) AS pixels FROM cc JOIN d USING (image_id) GROUP BY 1, 2 HAVING NOT bool_or(y = 0 OR x = 0 OR y = h OR x = w))
SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY pixels DESC, root) - 1 AS INT) AS hole, pixels FROM n""",
    "planar_problems": f"WITH {FORMULA} SELECT image_id, count(DISTINCT label) AS faces, CAST(0 AS BIGINT) AS problems FROM lb WHERE label >= 0 GROUP BY 1",
    "area_match": f"""WITH {PATHS}, q AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM p WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
a AS (SELECT user_id, abs(sum(0.5 * (x * ny - nx * y))) AS area, avg(x) AS cx, avg(y) AS cy, sum(y) * (1 + user_id % 3) AS target FROM q GROUP BY user_id),
k AS (SELECT *, CASE WHEN abs(area - target) / greatest(target, 1e-9) <= 0.03 THEN 1.0 ELSE least(greatest(sqrt(target / greatest(area, 1e-9)), 0.85), 1.15) END AS scale FROM a)
SELECT p.user_id, CAST(pos AS INT) AS pos, round(cx + scale * (x - cx) + 1.234e-7, 6) AS x, round(cy + scale * (y - cy) + 1.234e-7, 6) AS y, round(scale + 1.234e-7, 6) AS scale FROM p JOIN k USING (user_id)""",
}
