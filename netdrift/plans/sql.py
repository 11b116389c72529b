"""DuckDB SQL of the queries that SQL can express, with the tables of sources.panels as common table expressions."""

from __future__ import annotations

PANEL = """
sold AS (
  SELECT c_nationkey AS nk, o_orderpriority AS series, CAST(date_trunc('week', o_orderdate) AS DATE) AS ts, sum(o_totalprice) AS v
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL
), weeks AS (SELECT DISTINCT CAST(date_trunc('week', o_orderdate) AS DATE) AS ts FROM orders),
names AS (SELECT series, CAST(row_number() OVER (ORDER BY series) AS INTEGER) AS pos FROM (SELECT DISTINCT o_orderpriority AS series FROM orders)),
levels AS (
  SELECT n_name AS panel_id, names.series, pos, weeks.ts, ln(1 + coalesce(v, 0.0)) AS level
  FROM nation CROSS JOIN names CROSS JOIN weeks
  LEFT JOIN sold ON sold.nk = n_nationkey AND sold.series = names.series AND sold.ts = weeks.ts
), steps AS (
  SELECT panel_id, ts, series, pos, level - lag(level) OVER (PARTITION BY panel_id, series ORDER BY ts) AS value FROM levels
), panel AS (
  SELECT panel_id, ts, row_number() OVER (PARTITION BY panel_id, series ORDER BY ts) AS t, series, pos, value
  FROM steps WHERE value IS NOT NULL
)"""

THETA = """
flow AS (
  SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS ts, rs.r_name AS to_node, rc.r_name AS from_node, sum(l_extendedprice) AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation nc ON nc.n_nationkey = c_nationkey JOIN region rc ON rc.r_regionkey = nc.n_regionkey
  JOIN nation ns ON ns.n_nationkey = s_nationkey JOIN region rs ON rs.r_regionkey = ns.n_regionkey
  GROUP BY ALL
), cells AS (
  SELECT d.ts, a.r_name AS to_node, b.r_name AS from_node, coalesce(w, 0.0) AS w
  FROM (SELECT DISTINCT ts FROM flow) d CROSS JOIN region a CROSS JOIN region b
  LEFT JOIN flow ON flow.ts = d.ts AND flow.to_node = a.r_name AND flow.from_node = b.r_name
), theta AS (
  SELECT ts, to_node, from_node,
         CASE WHEN sum(w) OVER (PARTITION BY ts, to_node) > 0 THEN w / sum(w) OVER (PARTITION BY ts, to_node) ELSE 0.0 END AS theta
  FROM cells
)"""

#: theta by month with a panel for each order priority, and net edges of it.
PANEL_THETA = THETA.replace("SELECT CAST(date_trunc('week'", "SELECT o_orderpriority AS panel_id, CAST(date_trunc('month'").replace("SELECT d.ts,", "SELECT d.panel_id, d.ts,").replace(
    "SELECT DISTINCT ts FROM flow", "SELECT DISTINCT panel_id, ts FROM flow").replace("ON flow.ts = d.ts", "ON flow.panel_id = d.panel_id AND flow.ts = d.ts").replace(
    "SELECT ts, to_node, from_node,", "SELECT panel_id, ts, to_node, from_node,").replace("PARTITION BY ts, to_node", "PARTITION BY panel_id, ts, to_node")
PANEL_EDGES = PANEL_THETA + """, both_ways AS (
  SELECT x.panel_id, x.ts, x.to_node, x.from_node, x.theta - y.theta AS d
  FROM theta x JOIN theta y ON x.panel_id = y.panel_id AND x.ts = y.ts AND x.to_node = y.from_node AND x.from_node = y.to_node
), edges AS (
  SELECT panel_id, ts, CASE WHEN d > 0 THEN from_node ELSE to_node END AS source, CASE WHEN d > 0 THEN to_node ELSE from_node END AS target, abs(d) AS weight
  FROM both_ways WHERE to_node < from_node AND d <> 0
)"""

NATIONS = THETA.replace("'week'", "'month'").replace("rs.r_name AS to_node, rc.r_name AS from_node", "ns.n_name AS to_node, nc.n_name AS from_node").replace(
    "a.r_name AS to_node, b.r_name AS from_node", "a.n_name AS to_node, b.n_name AS from_node").replace(
    "CROSS JOIN region a CROSS JOIN region b", "CROSS JOIN nation a CROSS JOIN nation b").replace(
    "flow.to_node = a.r_name AND flow.from_node = b.r_name", "flow.to_node = a.n_name AND flow.from_node = b.n_name")

GROUPS = "groups AS (SELECT n_name AS node, r_name AS grp FROM nation JOIN region ON n_regionkey = r_regionkey)"

#: theta between regions, from the nations' table, with rows summing to 1 again.
GROUPED = NATIONS + ", " + GROUPS + """, summed AS (
  SELECT ts, coalesce(a.grp, 'Otros') AS to_node, coalesce(b.grp, 'Otros') AS from_node, sum(theta) AS theta
  FROM theta LEFT JOIN groups a ON a.node = to_node LEFT JOIN groups b ON b.node = from_node GROUP BY ALL
), grouped AS (
  SELECT ts, to_node, from_node,
         theta / CASE WHEN sum(theta) OVER (PARTITION BY ts, to_node) = 0 THEN 1 ELSE sum(theta) OVER (PARTITION BY ts, to_node) END AS theta
  FROM summed
)"""

PAIRS = PANEL + """, pairs AS (
  SELECT a.panel_id, a.ts, a.series AS a, b.series AS b, a.value AS x, b.value AS y
  FROM panel a JOIN panel b ON a.panel_id = b.panel_id AND a.ts = b.ts AND a.pos < b.pos
)"""

NET = THETA + """, net AS (
  SELECT ts, node, sum(s) AS s, sum(r) AS r FROM (
    SELECT ts, from_node AS node, theta AS s, 0.0 AS r FROM theta WHERE to_node <> from_node
    UNION ALL SELECT ts, to_node, 0.0, theta FROM theta WHERE to_node <> from_node) GROUP BY ALL
)"""

EDGES = THETA + """, edges AS (
  SELECT x.ts, CASE WHEN x.theta > y.theta THEN x.from_node ELSE x.to_node END AS source,
         CASE WHEN x.theta > y.theta THEN x.to_node ELSE x.from_node END AS target, abs(x.theta - y.theta) AS weight
  FROM theta x JOIN theta y ON x.ts = y.ts AND x.to_node = y.from_node AND x.from_node = y.to_node
  WHERE x.to_node < x.from_node AND x.theta <> y.theta
)"""

#: Net values of regions as index series with bands of 1.96 rolling deviations.
INDEX = NET + """, plain AS (
  SELECT node AS series, ts, row_number() OVER (PARTITION BY node ORDER BY ts) AS t, round((s - r) * 20, 9) + 0.0 AS value FROM net
), idx AS (
  SELECT *, value - 1.96 * sd AS lo, value + 1.96 * sd AS hi FROM (
    SELECT *, coalesce(stddev_samp(value) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), 0.0) AS sd FROM plain)
)"""

TCI = THETA + """, tci AS (
  SELECT 'tci' AS series, ts, row_number() OVER (ORDER BY ts) AS t, round(value, 9) + 0.0 AS value FROM (
    SELECT ts, sum(CASE WHEN to_node <> from_node THEN theta ELSE 0 END) * 20 AS value FROM theta GROUP BY ts)
)"""

PERIODS = """periods AS (SELECT ord, CAST(s AS DATE) AS start, CAST(e AS DATE) AS "end", name FROM (VALUES
  (1, '1995-03-06', '1995-06-30', 'harbour strike'), (2, '1995-09-15', '1995-09-15', 'price shock'),
  (3, '1996-05-06', '1996-12-02', 'credit squeeze'), (4, '1998-01-12', '1998-03-30', 'currency slide'),
  (5, '1999-11-08', '1999-11-08', 'storm week'), (6, '2000-02-24', '2001-01-15', 'long slump')) v(ord, s, e, name))"""

EPISODES = TCI + ", " + PERIODS + """, hot AS (
  SELECT *, value >= quantile_cont(value, 0.95) OVER (PARTITION BY series) AS hot FROM tci
), edged AS (
  SELECT *, CASE WHEN lag(hot) OVER (PARTITION BY series ORDER BY t) = hot THEN 0 ELSE 1 END AS edge FROM hot
), runs AS (SELECT *, sum(edge) OVER (PARTITION BY series ORDER BY t) AS run FROM edged),
episodes AS (
  SELECT series, min(ts) AS start_date, max(ts) AS end_date, date_diff('day', min(ts), max(ts)) + 1 AS duration_days, max(value) AS max_value
  FROM runs WHERE hot GROUP BY series, run
), named AS (
  SELECT series, start_date, end_date, duration_days, max_value, coalesce(string_agg(name, ' | ' ORDER BY ord), '-') AS events
  FROM episodes LEFT JOIN periods ON start_date <= "end" AND end_date >= start GROUP BY ALL
)"""

REQUESTS = """requests AS (
  SELECT r AS request, CAST(w AS DATE) AS wanted FROM (VALUES ('before', '1990-01-01'), ('inside', '1996-07-05'), ('sunday', '1997-02-09'),
  ('monday', '1998-03-02'), ('tie', '1997-05-08'), ('after', '2030-01-01')) v(r, w)
), dates AS (SELECT DISTINCT ts FROM theta)"""


def w(tables: str, select: str) -> str:
    return f"WITH {tables.strip()} {select.strip()}"


def r6(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0.0 AS {name}"


def as_of(choice: str) -> str:
    return w(THETA + ", " + REQUESTS, f"""
SELECT request, wanted, {choice} AS ts FROM requests LEFT JOIN LATERAL (
  SELECT max(ts) FILTER (ts <= wanted) AS before, min(ts) FILTER (ts >= wanted) AS after, max(ts) AS final FROM dates) d ON true""")


ACF = PANEL + """, centred AS (
  SELECT *, value - avg(value) OVER (PARTITION BY panel_id, series) AS d FROM panel
), acf AS (
  SELECT a.panel_id, a.series, CAST(k AS INTEGER) AS lag, sum(a.d * b.d) / any_value(v) AS acf
  FROM centred a JOIN (SELECT unnest(range(1, 25)) AS k) ON true
  JOIN centred b ON a.panel_id = b.panel_id AND a.series = b.series AND b.t = a.t - k
  JOIN (SELECT panel_id, series, sum(d * d) AS v FROM centred GROUP BY ALL) z ON z.panel_id = a.panel_id AND z.series = a.series
  GROUP BY ALL
)"""

MOMENTS = PANEL + """, mean AS (
  SELECT *, value - avg(value) OVER (PARTITION BY panel_id, series) AS d FROM panel
), moments AS (
  SELECT panel_id, series, count(*) AS n, avg(d*d) AS m2, avg(d*d*d) / pow(avg(d*d), 1.5) AS skewness, avg(d*d*d*d) / pow(avg(d*d), 2) - 3 AS excess_kurtosis
  FROM mean GROUP BY ALL
)"""



def erf(x: str) -> str:
    """erf of x >= 0 by its series of positive terms, nested; 1 to rounding from 6.4 on."""
    y = f"least(CAST({x} AS DOUBLE), 6.4)"
    return f"(2 / sqrt(pi()) * {y} * exp(-{y} * {y}) * list_reduce(range(321, 1, -2), lambda acc, k: 1 + 2 * {y} * {y} / k * acc, 1.0::DOUBLE))"


def cdf(z: str) -> str:
    """Normal distribution function."""
    return f"(0.5::DOUBLE * (1 + sign({z}) * {erf(f'abs({z}) / sqrt(2::DOUBLE)')}))"


def chi2_tail(stat: str, df: str, terms: int = 2000) -> str:
    """Chi-square tail by the series of the lower gamma function; 0 to rounding where stat is far beyond df."""
    x, a = f"greatest(least({stat} / 2, 600::DOUBLE), 1e-300)", f"({df} / 2.0::DOUBLE)"
    series = f"list_sum(list_transform(range(0, {terms}), lambda i: exp(({a} + i) * ln({x}) - {x} - lgamma({a} + i + 1))))"
    return f"CASE WHEN {stat} <= 0 THEN 1.0::DOUBLE ELSE least(greatest(1 - {series}, 0), 1) END"


def wilson_hilferty(stat: str, df: str) -> str:
    z = f"((pow({stat} / {df}, 1 / 3.0::DOUBLE) - (1 - 2 / (9.0::DOUBLE * {df}))) / sqrt(2 / (9.0::DOUBLE * {df})))"
    return f"(1 - {cdf(z)})"


def swept(name: str, source: str, key: str, size: int, pivots: int) -> str:
    """CTE ``name`` (key, n, m, logdet): the matrices m of ``source`` (key, n, m) after sweeping their first ``pivots`` rows,
    but for those that depend on the rows before.

    Of cross products of regressors and then of responses this leaves the inverse, the coefficients (m[regressor][response])
    and, below, the cross products of residuals.
    """
    cell = """CASE WHEN m[s][s] <= 1e-10 * d[s] THEN CASE WHEN i = s OR j = s THEN 0 ELSE m[i][j] END
  WHEN i = s AND j = s THEN 1 / m[s][s] WHEN i = s THEN m[s][j] / m[s][s] WHEN j = s THEN -m[i][s] / m[s][s] ELSE m[i][j] - m[i][s] * m[s][j] / m[s][s] END"""
    return f"""{name}_steps AS (
  SELECT {key}, n, m, list_transform(range(1, {size + 1}), lambda i: m[i][i]) AS d, 1 AS s, 0.0::DOUBLE AS logdet FROM {source}
  UNION ALL
  SELECT {key}, n, list_transform(range(1, {size + 1}), lambda i: list_transform(range(1, {size + 1}), lambda j: {cell})), d, s + 1, logdet + ln(greatest(m[s][s], 1e-300))
  FROM {name}_steps WHERE s <= {pivots}
), {name} AS (SELECT {key}, n, m, logdet FROM {name}_steps WHERE s = {pivots + 1})"""


def products(name: str, source: str, key: str, size: int) -> str:
    """CTE ``name`` (key, n, m): the cross products of the lists z of ``source`` (key, z)."""
    return f"""{name}_cells AS (
  SELECT {key}, i, j, sum(z[i] * z[j]) AS g, count(*) AS n FROM {source} CROSS JOIN (SELECT unnest(range(1, {size + 1})) AS i) CROSS JOIN (SELECT unnest(range(1, {size + 1})) AS j) GROUP BY ALL
), {name} AS (SELECT {key}, any_value(n) AS n, list(r ORDER BY i) AS m FROM (SELECT {key}, i, any_value(n) AS n, list(g ORDER BY j) AS r FROM {name}_cells GROUP BY {key}, i) GROUP BY {key})"""


def rw(tables: str, select: str) -> str:
    return f"WITH RECURSIVE {tables.strip()} {select.strip()}"


#: Panels packed by date, five series each.
def label_roots(jitter: str, select: str) -> str:
    """Vectors of two components with the entries a, b, d of their label's 2 x 2 second moments, jitter added, det its root
    of the determinant and tr the root of trace + 2 det: sigma^(1/2) = (sigma + det I) / tr, sigma^(-1/2) = (adj(sigma) + det I) / (det tr)."""
    return f"""
WITH vectors AS (
  SELECT CAST(label AS VARCHAR) AS panel_id, vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings WHERE embedding IS NOT NULL
), moments AS (SELECT panel_id, avg(x * x) AS a, avg(x * y) AS b, avg(y * y) AS d FROM vectors GROUP BY panel_id),
stirred AS (SELECT panel_id, a + {jitter} AS a, b, d + {jitter} AS d FROM moments),
roots AS (SELECT *, sqrt(a * d - b * b) AS det, sqrt(a + d + 2 * sqrt(a * d - b * b)) AS tr FROM stirred),
white AS (SELECT panel_id, vec_id, ((d + det) * x - b * y) / (det * tr) AS w0, ((a + det) * y - b * x) / (det * tr) AS w1,
          ((a + det) * x + b * y) / tr AS v0, ((d + det) * y + b * x) / tr AS v1 FROM vectors JOIN roots USING (panel_id))
{select}"""


#: Residuals e of each series: about its mean, or of the regression on the row before and a constant; their products at all lags under 400.
def _residual_products(residuals: str) -> str:
    return PANEL + f""", {residuals}, products AS (
  SELECT a.panel_id, a.series, k, sum(a.e * b.e) AS c FROM e a JOIN (SELECT unnest(range(0, 400)) AS k) ON true
  JOIN e b ON a.panel_id = b.panel_id AND a.series = b.series AND b.t = a.t - k GROUP BY ALL
)"""


KPSS = w(_residual_products("e AS (SELECT panel_id, series, t, value - avg(value) OVER (PARTITION BY panel_id, series) AS e, count(*) OVER (PARTITION BY panel_id, series) AS n FROM panel)"), f"""
, sizes AS (SELECT panel_id, series, any_value(n) AS n FROM e GROUP BY ALL),
first AS (SELECT panel_id, series, n, sum(CASE WHEN k = 0 THEN c / n ELSE c * 2 / n END) AS s0, sum(k * c * 2 / n) AS s1
  FROM products JOIN sizes USING (panel_id, series) WHERE k <= floor(pow(n, 2 / 9::DOUBLE)) GROUP BY panel_id, series, n),
width AS (SELECT *, CAST(least(floor(1.1447 * pow((s1 / s0) * (s1 / s0), 1 / 3::DOUBLE) * pow(n, 1 / 3::DOUBLE)), n - 1) AS INTEGER) AS lags FROM first),
long_run AS (SELECT panel_id, series, n, lags, sum(CASE WHEN k = 0 THEN c ELSE 2 * c * (1 - k / (lags + 1)) END) / n AS v FROM products JOIN width USING (panel_id, series) WHERE k <= lags GROUP BY panel_id, series, n, lags),
walks AS (SELECT panel_id, series, sum(e) OVER (PARTITION BY panel_id, series ORDER BY t) AS s FROM e),
found AS (SELECT panel_id, series, any_value(lags) AS lags, sum(s * s) / any_value(n) / any_value(n) / any_value(v) AS stat FROM walks JOIN long_run USING (panel_id, series) GROUP BY panel_id, series)
SELECT panel_id, series, {r6('stat', 'stat')}, {r6("""CASE WHEN stat <= 0.347 THEN 0.1 WHEN stat <= 0.463 THEN 0.1 - 0.05 * (stat - 0.347) / 0.116 WHEN stat <= 0.574 THEN 0.05 - 0.025 * (stat - 0.463) / 0.111
  WHEN stat <= 0.739 THEN 0.025 - 0.015 * (stat - 0.574) / 0.165 ELSE 0.01 END""", 'p')}, lags, CAST(NULL AS INTEGER) AS nobs,
0.739::DOUBLE AS crit_1, 0.463::DOUBLE AS crit_5, 0.347::DOUBLE AS crit_10, CAST(NULL AS VARCHAR) AS error FROM found""")

PHILLIPS_PERRON = w(_residual_products("""steps_of AS (SELECT panel_id, series, t, value AS y, lag(value) OVER (PARTITION BY panel_id, series ORDER BY t) AS z FROM panel),
fit AS (SELECT panel_id, series, regr_slope(y, z) AS b, regr_intercept(y, z) AS a, count(z) AS n, regr_sxx(y, z) AS sxx FROM steps_of WHERE z IS NOT NULL GROUP BY ALL),
e AS (SELECT panel_id, series, t, y - a - b * z AS e FROM steps_of JOIN fit USING (panel_id, series) WHERE z IS NOT NULL)"""), f"""
, sums AS (SELECT panel_id, series, n, b, sxx, CAST(ceil(12 * pow((n + 1) / 100, 0.25)) AS INTEGER) AS lags, max(c) FILTER (k = 0) / n AS g0,
  sum(CASE WHEN k = 0 THEN c ELSE 2 * c * (1 - k / (ceil(12 * pow((n + 1) / 100, 0.25)) + 1)) END) FILTER (k <= ceil(12 * pow((n + 1) / 100, 0.25))) / n AS v
  FROM products JOIN fit USING (panel_id, series) GROUP BY panel_id, series, n, b, sxx),
found AS (SELECT *, sqrt(g0 / v) * (b - 1) / sqrt(g0 * n / (n - 2) / sxx) - 0.5 * (v - g0) / sqrt(v) * n * sqrt(g0 * n / (n - 2) / sxx) / sqrt(g0 * n / (n - 2)) AS stat FROM sums),
scored AS (SELECT *, CASE WHEN stat <= -1.61 THEN 2.1659 + 1.4412 * stat + 0.038269 * stat * stat ELSE 1.7339 + 0.93202 * stat - 0.12745 * stat * stat - 0.010368 * stat * stat * stat END AS z FROM found)
SELECT panel_id, series, {r6('stat', 'stat')}, {r6(f"CASE WHEN stat > 2.74 THEN 1 WHEN stat < -18.83 THEN 0 ELSE {cdf('z')} END", 'p')}, lags, CAST(n AS INTEGER) AS nobs,
{r6('-3.43035 - 6.5393 / n - 16.786 / (n * n) - 79.433 / (n * n * n)', 'crit_1')}, {r6('-2.86154 - 2.8903 / n - 4.234 / (n * n) - 40.04 / (n * n * n)', 'crit_5')},
{r6('-2.56677 - 1.5384 / n - 2.809 / (n * n)', 'crit_10')}, CAST(NULL AS VARCHAR) AS error FROM scored""")


def both(first: str, second: str, name: str, source: str = "white") -> str:
    return f"SELECT panel_id, vec_id, CAST(0 AS INTEGER) AS i, {r6(first, name)} FROM {source} UNION ALL SELECT panel_id, vec_id, CAST(1 AS INTEGER) AS i, {r6(second, name)} FROM {source}"


PACKED = PANEL + """, packed AS (SELECT panel_id, t, list(value ORDER BY pos) AS y FROM panel GROUP BY panel_id, t)"""


VECH = "flatten(list_transform(range(1, len(y) + 1), lambda i: list_transform(range(1, i + 1), lambda j: y[i] * y[j])))"
VEC = "flatten(list_transform(range(1, len(y) + 1), lambda i: list_transform(range(1, len(y) + 1), lambda j: y[i] * y[j])))"


def _regressed(outer: str, n: int, lags: int, response: str, responses: int) -> str:
    """Sweeps of [1, lags of ``outer``, ``response``] of packed rows: CTE fit (panel_id, n, m, logdet), and gram before it."""
    z = "[1.0::DOUBLE] || " + " || ".join(f"lag(v, {k}) OVER o" for k in range(1, lags + 1)) + " || r"
    size = 1 + n * lags + responses
    return PACKED + f""", outers AS (SELECT panel_id, t, {outer} AS v, {response} AS r FROM packed),
zs AS (SELECT panel_id, t, {z} AS z FROM outers WINDOW o AS (PARTITION BY panel_id ORDER BY t)),
complete AS (SELECT panel_id, z FROM zs WHERE t > {lags}),
""" + products("gram", "complete", "panel_id", size) + ", " + swept("fit", "gram", "panel_id", size, size - responses)


def _arch(response: str, responses: int, n: int = 15, lags: int = 2) -> str:
    """Of outer products on lags of their lower triangles: whole products as regressors span the same."""
    first, last, df = 2 + n * lags, 1 + n * lags + responses, responses * lags
    cells = f"range({first}, {last + 1})"
    share = f"""1 - list_sum(list_transform({cells}, lambda i: fit.m[i][i])) / list_sum(list_transform({cells}, lambda i: gram.m[i][i] - gram.m[1][i] * gram.m[1][i] / gram.n))"""
    return rw(_regressed(VECH, n, lags, response, responses), f""", told AS (SELECT panel_id, gram.n * ({share}) AS stat FROM fit JOIN gram USING (panel_id))
SELECT panel_id, {r6('stat', 'stat')}, {df}::DOUBLE AS df, {r6(wilson_hilferty('stat', str(df)), 'p')} FROM told""")


def _covariances(value: str, lags: int, over: str) -> str:
    """CTEs c (panel_id, k, i, j, v) of centred values, for lags 0 to ``lags``, and prec (panel_id, i, j, v), the inverse at lag 0."""
    return PANEL + f""", centred AS (SELECT panel_id, t, pos AS i, {value} - avg({value}) OVER (PARTITION BY panel_id, pos) AS d, max(t) OVER (PARTITION BY panel_id) AS size FROM panel),
c AS (SELECT a.panel_id, k, a.i, b.i AS j, any_value(a.size) AS size, sum(a.d * b.d) / {over} AS v FROM centred a JOIN (SELECT unnest(range(0, {lags + 1})) AS k) ON true
  JOIN centred b ON a.panel_id = b.panel_id AND b.t = a.t - k GROUP BY a.panel_id, k, a.i, b.i),
cov AS (SELECT panel_id, any_value(n) AS n, list(r ORDER BY i) AS m FROM (SELECT panel_id, i, any_value(size) AS n, list(v ORDER BY j) AS r FROM c WHERE k = 0 GROUP BY panel_id, i) GROUP BY panel_id),
""" + swept("inv", "cov", "panel_id", 5, 5) + """,
prec AS (SELECT panel_id, i, j, m[i][j] AS v FROM inv CROSS JOIN (SELECT unnest(range(1, 6)) AS i) CROSS JOIN (SELECT unnest(range(1, 6)) AS j))"""


def _hosking(value: str) -> str:
    return rw(_covariances(value, 10, "any_value(a.size)"), f""", l AS (SELECT c.panel_id, k, p.i, c.j, any_value(size) AS size, sum(p.v * c.v) AS v FROM c JOIN prec p ON p.panel_id = c.panel_id AND p.j = c.i GROUP BY ALL),
lr AS (SELECT l.panel_id, k, l.i, p.j, sum(l.v * p.v) AS v FROM l JOIN prec p ON p.panel_id = l.panel_id AND p.i = l.j GROUP BY ALL),
told AS (SELECT c.panel_id, sum(c.v * lr.v / (size - k)) * any_value(size) * any_value(size) AS stat FROM c JOIN lr USING (panel_id, k, i, j) WHERE k > 0 GROUP BY c.panel_id)
SELECT panel_id, {r6('stat', 'stat')}, {r6(chi2_tail('stat', '250'), 'p')}, 250.0::DOUBLE AS df FROM told""")


#: Mardia's statistics by all pairs of rows.
MARDIA = _covariances("value", 0, "any_value(a.size)") + """, u AS (SELECT d.panel_id, d.t, p.i, any_value(d.size) AS size, sum(p.v * d.d) AS u FROM centred d JOIN prec p ON p.panel_id = d.panel_id AND p.j = d.i GROUP BY ALL),
packed AS (SELECT panel_id, t, any_value(size) AS size, list(d ORDER BY i) AS d FROM centred GROUP BY panel_id, t), packed_u AS (SELECT panel_id, t, list(u ORDER BY i) AS u FROM u GROUP BY panel_id, t),
mardia AS (SELECT panel_id, any_value(size) AS size, sum(pow(g, 3)) / any_value(size) / 6 AS skew, sum(CASE WHEN same THEN g * g END) / any_value(size) AS kurt FROM (
  SELECT a.panel_id, a.size, a.t = b.t AS same, list_dot_product(a.d, b.u) AS g FROM packed a JOIN packed_u b ON a.panel_id = b.panel_id) GROUP BY panel_id),
told AS (SELECT panel_id, skew, (kurt - 35) / sqrt(280.0::DOUBLE / size) AS z FROM mardia)"""

ORDERED = PANEL + f""", stats AS (SELECT panel_id, series, count(*) AS n, avg(value) AS mu, greatest(stddev_samp(value), 1e-12) AS sd FROM panel GROUP BY ALL),
ordered AS (SELECT panel_id, series, n, row_number() OVER (PARTITION BY panel_id, series ORDER BY value) AS i, value, greatest(least({cdf('((value - mu) / sd)')}, 1 - 1e-12), 1e-12) AS f FROM panel JOIN stats USING (panel_id, series))"""

#: Normal quantiles of the medians of order statistics by bisection, for each series length.
MEDIANS = PANEL + f""", sizes AS (SELECT DISTINCT n FROM (SELECT count(*) AS n FROM panel GROUP BY panel_id, series)),
medians AS (SELECT n, i, CASE WHEN i = n THEN pow(0.5::DOUBLE, 1.0::DOUBLE / n) WHEN i = 1 THEN 1 - pow(0.5::DOUBLE, 1.0::DOUBLE / n) ELSE (i - 0.3175::DOUBLE) / (n + 0.365::DOUBLE) END AS p FROM (SELECT n, unnest(range(1, n + 1)) AS i FROM sizes)),
halves AS (SELECT n, i, p, -8.0::DOUBLE AS low, 8.0::DOUBLE AS high, 0 AS s FROM medians UNION ALL
  SELECT n, i, p, CASE WHEN below THEN (low + high) / 2 ELSE low END, CASE WHEN below THEN high ELSE (low + high) / 2 END, s + 1 FROM (SELECT *, {cdf('((low + high) / 2)')} < p AS below FROM halves WHERE s < 55)),
quantiles AS (SELECT n, i, (low + high) / 2 AS q FROM halves WHERE s = 55)"""

_Y = "(2 * (i - 0.5::DOUBLE) / n - 1)"
_LOG = f"ln(1 - {_Y} * {_Y})"
_HALF = f"(2 / (pi() * 0.147::DOUBLE) + {_LOG} / 2)"
_START = f"(CASE WHEN {_Y} < 0 THEN -1 ELSE 1 END * sqrt(greatest(sqrt({_HALF} * {_HALF} - {_LOG} / 0.147::DOUBLE) - {_HALF}, 0)))"

ORACLE: dict[str, str] = {
    "p01_choose_series": w(PANEL, f"SELECT panel_id, ts, series, {r6('value', 'value')} FROM panel WHERE series IN ('1-URGENT', '5-LOW')"),
    "p02_reshape": w(PANEL, f"SELECT panel_id, ts, series, {r6('value', 'value')} FROM panel"),
    "p03_ordinal": w(PANEL, "SELECT panel_id, series, ts, t FROM panel"),
    "p04_coerce": "SELECT event_id, TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'bad' || value ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS value FROM events WHERE event_id % 7 <> 0 AND value IS NOT NULL",
    "p05_long_enough": "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) >= 20",
    "p06_numeric_columns": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem",
    "p07_lagged_design": w(PANEL, f"""
, packed AS (SELECT panel_id, ts, any_value(t) AS t, list(value ORDER BY pos) AS y FROM panel GROUP BY panel_id, ts),
d AS (SELECT panel_id, ts, t, y, lag(y, 1) OVER (PARTITION BY panel_id ORDER BY t) AS a, lag(y, 2) OVER (PARTITION BY panel_id ORDER BY t) AS b FROM packed)
SELECT panel_id, ts, t, {r6('list_sum(y)', 'sum_y')}, {r6('list_sum(a) + 2 * list_sum(b) + 1', 'sum_x')}, {r6('b[5]', 'last_x')}, CAST(len(a) + len(b) + 1 AS INTEGER) AS k
FROM d WHERE t > 2"""),
    "p08_common_sample": w(PANEL, "SELECT panel_id, CAST(p AS INTEGER) AS p, count(DISTINCT t) FILTER (t > 4) AS t_eff FROM panel CROSS JOIN (SELECT unnest([1, 2, 4]) AS p) GROUP BY ALL"),
    "p09_store_draws": w(PANEL, f"SELECT panel_id, count(*) AS n, {r6('sum(value)', 'total')} FROM panel GROUP BY panel_id"),
    "p10_nonfinite": "SELECT 'value' AS \"column\", count(*) FILTER (value = 0) AS n FROM events",
    "p11_relabel": "SELECT coalesce(r_name, n_name) AS node, count(*) AS n FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA' GROUP BY 1",
    "d01_summary": w(PANEL, f"""SELECT panel_id, series, count(value) AS n, {r6('min(value) * 100', 'low')}, {r6('max(value) * 100', 'high')}, min(ts) AS first_ts, max(ts) AS last_ts,
{r6('(max(value) * 100 - min(value) * 100) * 0.05', 'value_pad')}, date_diff('day', min(ts), max(ts)) AS span_days, {r6("date_diff('day', min(ts), max(ts)) * 0.02::DOUBLE", 'time_pad_days')} FROM panel GROUP BY ALL"""),
    "d02_pearson": w(PAIRS, f"SELECT panel_id, a, b, {r6('corr(x, y)', 'corr')}, count(*) AS n FROM pairs GROUP BY ALL"),
    "d03_spearman": w(PAIRS, f"""
, ranked AS (SELECT panel_id, a, b, rank() OVER (PARTITION BY panel_id, a, b ORDER BY x) + (count(*) OVER (PARTITION BY panel_id, a, b, x) - 1) / 2.0::DOUBLE AS x,
  rank() OVER (PARTITION BY panel_id, a, b ORDER BY y) + (count(*) OVER (PARTITION BY panel_id, a, b, y) - 1) / 2.0::DOUBLE AS y FROM pairs)
SELECT panel_id, a, b, {r6('corr(x, y)', 'corr')}, count(*) AS n FROM ranked GROUP BY ALL"""),
    "d04_kendall": w(PAIRS, f"""
, n AS (SELECT *, row_number() OVER (PARTITION BY panel_id, a, b ORDER BY ts) AS i FROM pairs),
s AS (SELECT l.panel_id, l.a, l.b, sum(sign(l.x - r.x) * sign(l.y - r.y)) AS c, sqrt(sum(abs(sign(l.x - r.x)))::DOUBLE) * sqrt(sum(abs(sign(l.y - r.y)))::DOUBLE) AS scale
  FROM n l JOIN n r ON l.panel_id = r.panel_id AND l.a = r.a AND l.b = r.b AND l.i < r.i GROUP BY ALL)
SELECT panel_id, a, b, {r6("CASE WHEN scale = 0 THEN 'NaN'::DOUBLE ELSE c / scale END", 'tau')} FROM s"""),
    "d08_histogram_standardized": w(PANEL, f"""
, z AS (SELECT panel_id, series, (value - avg(value) OVER s) / greatest(stddev_samp(value) OVER s, 1e-12) AS value FROM panel WINDOW s AS (PARTITION BY panel_id, series)),
s AS (SELECT panel_id, series, min(value) AS low, max(value) AS high, count(*) AS n FROM z GROUP BY ALL),
b AS (SELECT panel_id, series, CAST(least(floor(round((value - low) / ((high - low) / 30), 9)), 29) AS INTEGER) AS bin, count(*) AS "count", any_value(low) AS low, any_value(high) AS high, any_value(n) AS n
FROM z JOIN s USING (panel_id, series) GROUP BY ALL)
SELECT panel_id, series, bin, "count", {r6('"count" / (n * ((high - low) / 30))', 'density')}, {r6('low + (bin + 0.5::DOUBLE) * ((high - low) / 30)', 'middle')},
{r6('exp(-pow(low + (bin + 0.5::DOUBLE) * ((high - low) / 30), 2) / 2) / sqrt(2 * pi())', 'normal')} FROM b"""),
    "d10_qq_fit": rw(MEDIANS, f"""
, o AS (SELECT panel_id, series, value, row_number() OVER (PARTITION BY panel_id, series ORDER BY value) AS i, count(*) OVER (PARTITION BY panel_id, series) AS n FROM panel)
SELECT panel_id, series, {r6('regr_slope(value, q)', 'slope')}, {r6('regr_intercept(value, q)', 'intercept')}, {r6('corr(value, q)', 'r')} FROM o JOIN quantiles USING (n, i) GROUP BY ALL"""),
    "d11_qq_points": w(PANEL, f"""
, o AS (SELECT panel_id, series, (value - avg(value) OVER s) / greatest(stddev_samp(value) OVER s, 1e-12) AS z, row_number() OVER (PARTITION BY panel_id, series ORDER BY value) AS i, count(*) OVER s AS n
  FROM panel WINDOW s AS (PARTITION BY panel_id, series)),
x AS (SELECT DISTINCT n, i, {_Y} AS y, {_START} AS x FROM o),
e AS (SELECT n, i, x - (sign(x) * {erf('abs(x)')} - y) * sqrt(pi()) / 2 * exp(x * x) AS x FROM x)
SELECT panel_id, series, CAST(i AS INTEGER) AS i, {r6('sqrt(2::DOUBLE) * x', 'theory')}, {r6('z', 'z')} FROM o JOIN e USING (n, i)"""),
    "d12_pp_points": w(ORDERED, f"SELECT panel_id, series, CAST(i AS INTEGER) AS i, {r6('i / n', 'empirical')}, {r6('f', 'normal')} FROM ordered"),
    "g01_jarque_bera": w(MOMENTS, f""", j AS (SELECT panel_id, series, n / 6.0::DOUBLE * (skewness * skewness + 0.25 * excess_kurtosis * excess_kurtosis) AS jb FROM moments)
SELECT panel_id, series, {r6('jb', 'jb')}, {r6(wilson_hilferty('jb', '2'), 'p')} FROM j"""),
    "g02_anderson_darling": w(ORDERED, f"""
, a AS (SELECT l.panel_id, l.series, (-any_value(l.n) - sum((2 * l.i - 1) * (ln(l.f) + ln(1 - r.f))) / any_value(l.n)) * (1 + 4.0::DOUBLE / any_value(l.n) - 25.0::DOUBLE / (any_value(l.n) * any_value(l.n))) AS a
  FROM ordered l JOIN ordered r ON l.panel_id = r.panel_id AND l.series = r.series AND r.i = l.n + 1 - l.i GROUP BY l.panel_id, l.series)
SELECT panel_id, series, {r6('a', 'stat')}, {r6("""least(greatest(CASE WHEN a < 0.2 THEN 1 - exp(-13.436 + 101.14 * a - 223.73 * a * a) WHEN a < 0.34 THEN 1 - exp(-8.318 + 42.796 * a - 59.938 * a * a)
  WHEN a < 0.6 THEN exp(0.9177 - 4.279 * a - 1.38 * a * a) ELSE exp(least(1.2937 - 5.709 * a + 0.0186 * a * a, 700)) END, 0), 1)""", 'p')} FROM a"""),
    "g03_kolmogorov_smirnov": w(ORDERED, f"""
, k AS (SELECT panel_id, series, any_value(n) AS n, max(greatest(i / n - f, f - (i - 1) / n)) AS d FROM ordered GROUP BY ALL),
m AS (SELECT *, (sqrt(n) + 0.12::DOUBLE + 0.11::DOUBLE / sqrt(n)) * d AS lam FROM k)
SELECT panel_id, series, {r6('d', 'd')}, {r6("least(greatest(2 * list_sum(list_transform(range(1, 101), lambda j: CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END * exp(-2 * j * j * lam * lam))), 0), 1)", 'p')} FROM m"""),
    "g04_cramer_von_mises_stat": w(ORDERED, f"SELECT panel_id, series, {r6('1 / (12.0::DOUBLE * any_value(n)) + sum(pow(f - (2 * i - 1) / (2.0::DOUBLE * n), 2))', 'w2')} FROM ordered GROUP BY ALL"),
    "g06_ljung_box": w(ACF, f""", s AS (SELECT panel_id, series, max(t) AS n FROM panel GROUP BY ALL),
q AS (SELECT acf.panel_id, acf.series, any_value(n) * (any_value(n) + 2.0::DOUBLE) * sum(acf * acf / (n - lag)) AS q FROM acf JOIN s ON s.panel_id = acf.panel_id AND s.series = acf.series WHERE lag <= 10 GROUP BY acf.panel_id, acf.series)
SELECT panel_id, series, {r6('q', 'q')}, {r6(wilson_hilferty('q', '10'), 'p')} FROM q"""),
    "g07_arch_lm": rw(PANEL + """, sq AS (SELECT panel_id || '|' || series AS key, t, value * value AS s FROM panel),
zs AS (SELECT key, t, [1.0::DOUBLE, lag(s, 1) OVER o, lag(s, 2) OVER o, lag(s, 3) OVER o, lag(s, 4) OVER o, lag(s, 5) OVER o, s] AS z FROM sq WINDOW o AS (PARTITION BY key ORDER BY t)),
complete AS (SELECT key, z FROM zs WHERE t > 5), """ + products("gram", "complete", "key", 7) + ", " + swept("fit", "gram", "key", 7, 6), f"""
, told AS (SELECT key, gram.n * (1 - fit.m[7][7] / (gram.m[7][7] - gram.m[1][7] * gram.m[1][7] / gram.n)) AS lm FROM fit JOIN gram USING (key))
SELECT split_part(key, '|', 1) AS panel_id, split_part(key, '|', 2) AS series, {r6('lm', 'lm')}, {r6(wilson_hilferty('lm', '5'), 'p')} FROM told"""),
    "g08_multivariate_arch_lm": _arch(VECH, 15),
    "g08_multivariate_arch_lm_vec": _arch(VEC, 25),
    "g09_portmanteau": rw(_covariances("value", 10, "count(*)"), f""", r AS (SELECT c.panel_id, k, c.i, p.j, any_value(size) AS size, sum(c.v * p.v) AS v FROM c JOIN prec p ON p.panel_id = c.panel_id AND p.i = c.j GROUP BY ALL),
told AS (SELECT panel_id, sum(v * v * size * size / (size - k)) AS stat FROM r WHERE k > 0 GROUP BY panel_id)
SELECT panel_id, {r6('stat', 'stat')}, 250.0::DOUBLE AS df, {r6(wilson_hilferty('stat', '250'), 'p')} FROM told"""),
    "g10_hosking": _hosking("value"),
    "g11_hosking_squares": _hosking("value * value"),
    "g13_mardia": rw(MARDIA, f"SELECT panel_id, {r6('skew', 'skew_stat')}, {r6(chi2_tail('skew', '35'), 'skew_p')}, {r6('z', 'kurt_z')}, {r6('2 * (1 - ' + cdf('abs(z)') + ')', 'kurt_p')} FROM told"),
    "g14_mardia_robust": rw(MARDIA, f"SELECT panel_id, {r6('skew', 'skew_stat')}, {r6(wilson_hilferty('skew', '35'), 'skew_p')}, {r6('z', 'kurt_z')}, {r6('2 * (1 - ' + cdf('abs(z)') + ')', 'kurt_p')} FROM told"),
    "g15_autocorrelation_lr": rw(_regressed("y", 5, 5, "y", 5) + """, own AS (SELECT panel_id, n, list_transform(range(27, 32), lambda i: list_transform(range(27, 32), lambda j: m[i][j] / n)) AS m FROM gram),
rest AS (SELECT panel_id, n, list_transform(range(27, 32), lambda i: list_transform(range(27, 32), lambda j: m[i][j] / n)) AS m FROM fit), """ + swept("before", "own", "panel_id", 5, 5) + ", " + swept("after", "rest", "panel_id", 5, 5), f"""
, told AS (SELECT panel_id, (before.n - 5 * 5 - 5 - 1) * (before.logdet - after.logdet) AS stat FROM before JOIN after USING (panel_id))
SELECT panel_id, {r6('stat', 'stat')}, {r6(chi2_tail('stat', '125'), 'p')} FROM told"""),
    "k01_ols_prior": rw(PACKED + """, zs AS (SELECT panel_id, t, lag(y) OVER (PARTITION BY panel_id ORDER BY t) || [1.0::DOUBLE] || y AS z FROM packed),
complete AS (SELECT panel_id, z FROM zs WHERE t BETWEEN 2 AND 251), """ + products("gram", "complete", "panel_id", 11) + ", " + swept("fit", "gram", "panel_id", 11, 6), f"""
SELECT panel_id, CAST((e - 1) * 6 + r - 1 AS INTEGER) AS i, {r6('m[r][6 + e]', 'b')} FROM fit CROSS JOIN (SELECT unnest(range(1, 6)) AS e) CROSS JOIN (SELECT unnest(range(1, 7)) AS r)"""),
    "m01_least_eigenvalues": label_roots("0.0", f"SELECT panel_id, true AS ok, {r6('(a + d - sqrt((a - d) * (a - d) + 4 * b * b)) / 2', 'least_eigenvalue')}, 'ok' AS reason FROM moments"),
    "m02_whiten_labels": label_roots("1e-10", both("w0 - avg(w0) OVER (PARTITION BY panel_id)", "w1 - avg(w1) OVER (PARTITION BY panel_id)", "w")),
    "m03_whiten_scaled_labels": label_roots("1e-3 * (a + d) / 2", both("w0", "w1", "w")),
    "m04_colour_labels": label_roots("1e-10 * (a + d) / 2", both("v0", "v1", "v")),
    "n01_theta_as_of": w(THETA + ", " + REQUESTS, f"""
, d AS (SELECT request, wanted, CASE WHEN before IS NULL THEN after WHEN after IS NULL THEN before WHEN date_diff('day', before, wanted) <= date_diff('day', wanted, after) THEN before ELSE after END AS ts
  FROM requests LEFT JOIN LATERAL (SELECT max(ts) FILTER (ts <= wanted) AS before, min(ts) FILTER (ts >= wanted) AS after FROM dates) x ON true)
SELECT request, wanted, ts, to_node, from_node, {r6('theta', 'theta')} FROM d JOIN theta USING (ts)"""),
    "n16_ordered_contributions": w(THETA, f"""SELECT ts, to_node, from_node, {r6('100 * theta / CASE WHEN sum(theta) OVER (PARTITION BY ts) = 0 THEN 1 ELSE sum(theta) OVER (PARTITION BY ts) END', 'share')},
CAST(CASE from_node WHEN 'EUROPE' THEN 1 WHEN 'AFRICA' THEN 2 WHEN 'AMERICA' THEN 3 WHEN 'MIDDLE EAST' THEN 4 ELSE 5 END AS INTEGER) AS place FROM theta WHERE to_node = 'ASIA'"""),
    "e04_periods_start_inside": w(TCI + ", " + PERIODS, """SELECT series, ord, start, "end", name FROM (SELECT series, min(ts) AS a, max(ts) AS b FROM tci WHERE ts >= DATE '1996-06-01' GROUP BY series) JOIN periods ON start <= b AND start >= a"""),
    "d05_rolling_volatility": w(PANEL, f"""SELECT panel_id, series, ts, t, {r6('volatility', 'volatility')} FROM (
SELECT *, stddev_samp(value) OVER (PARTITION BY panel_id, series ORDER BY t ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS volatility FROM panel) WHERE t >= 60"""),
    "d06_rolling_correlation": w(PAIRS, f"""SELECT panel_id, a, b, ts, {r6('rolling', 'rolling')}, {r6('static', 'static')} FROM (
SELECT *, CASE WHEN min(x) OVER f < max(x) OVER f AND min(y) OVER f < max(y) OVER f THEN corr(x, y) OVER f END AS rolling, count(*) OVER f AS n, corr(x, y) OVER (PARTITION BY panel_id, a, b) AS static FROM pairs
WINDOW f AS (PARTITION BY panel_id, a, b ORDER BY ts ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)) WHERE n = 252"""),
    "d07_above_static": w(PAIRS, """SELECT panel_id, a, b, count(*) AS windows, count(*) FILTER (round(rolling, 9) >= round(static, 9)) AS above FROM (
SELECT *, CASE WHEN min(x) OVER f < max(x) OVER f AND min(y) OVER f < max(y) OVER f THEN corr(x, y) OVER f END AS rolling, count(*) OVER f AS n, corr(x, y) OVER (PARTITION BY panel_id, a, b) AS static FROM pairs
WINDOW f AS (PARTITION BY panel_id, a, b ORDER BY ts ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)) WHERE n = 252 GROUP BY ALL"""),
    "d08_histogram": w(PANEL, f"""
, s AS (SELECT panel_id, series, avg(value) AS mu, stddev_samp(value) AS sd, min(value) AS low, max(value) AS high, count(*) AS n FROM panel GROUP BY ALL),
b AS (SELECT panel_id, series, CAST(least(floor(round((value - low) / ((high - low) / 60), 9)), 59) AS INTEGER) AS bin, count(*) AS "count", any_value(low) AS low, any_value(high) AS high, any_value(mu) AS mu, any_value(sd) AS sd, any_value(n) AS n
FROM panel JOIN s USING (panel_id, series) GROUP BY ALL)
SELECT panel_id, series, bin, "count", {r6('"count" / (n * ((high - low) / 60))', 'density')}, {r6('low + (bin + 0.5::DOUBLE) * ((high - low) / 60)', 'middle')},
{r6('exp(-pow((low + (bin + 0.5::DOUBLE) * ((high - low) / 60) - mu) / sd, 2) / 2) / (sd * sqrt(2 * pi()))', 'normal')} FROM b"""),
    "d09_box": w(PANEL, f"""
, q AS (SELECT panel_id, series, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM panel GROUP BY ALL)
SELECT panel_id, series, {r6('q1', 'q1')}, {r6('median', 'median')}, {r6('q3', 'q3')},
{r6('min(value) FILTER (value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1))', 'low_whisker')}, {r6('max(value) FILTER (value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1))', 'high_whisker')},
count(*) FILTER (NOT (value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1))) AS outliers
FROM panel JOIN q USING (panel_id, series) GROUP BY panel_id, series, q.q1, q.median, q.q3"""),
    "d14_acf": w(ACF, f"SELECT panel_id, series, lag, {r6('acf', 'acf')} FROM acf"),
    "d13_acf_bound": w(PANEL, f"""
, twice AS (SELECT panel_id, series, t, kind, v - avg(v) OVER (PARTITION BY panel_id, series, kind) AS d FROM (
  SELECT panel_id, series, t, 'plain' AS kind, value AS v FROM panel UNION ALL SELECT panel_id, series, t, 'square', value * value FROM panel)),
z AS (SELECT panel_id, series, kind, sum(d * d) AS v FROM twice GROUP BY ALL),
acf AS (SELECT a.panel_id, a.series, a.kind, k, sum(a.d * b.d) / any_value(z.v) AS acf FROM twice a JOIN (SELECT unnest(range(1, 41)) AS k) ON true
  JOIN twice b ON a.panel_id = b.panel_id AND a.series = b.series AND a.kind = b.kind AND b.t = a.t - k JOIN z ON z.panel_id = a.panel_id AND z.series = a.series AND z.kind = a.kind GROUP BY ALL)
SELECT panel_id, series, {r6('greatest(1.2 * max(abs(acf)), 0.1)', 'bound')} FROM acf GROUP BY ALL"""),
    "d15_ccf": w(PAIRS, f"""
, c AS (SELECT panel_id, a, b, ts, row_number() OVER p AS i, x - avg(x) OVER (PARTITION BY panel_id, a, b) AS x, y - avg(y) OVER (PARTITION BY panel_id, a, b) AS y FROM pairs WINDOW p AS (PARTITION BY panel_id, a, b ORDER BY ts)),
z AS (SELECT panel_id, a, b, sqrt(sum(x * x) * sum(y * y)) AS norm, count(*) AS n FROM c GROUP BY ALL)
SELECT l.panel_id, l.a, l.b, CAST(k AS INTEGER) AS lag, {r6('sum(l.x * r.y) / any_value(norm)', 'ccf')}, {r6('1.96 / sqrt(any_value(n))', 'band')}
FROM c l JOIN (SELECT unnest(range(-24, 25)) AS k) ON true JOIN c r ON l.panel_id = r.panel_id AND l.a = r.a AND l.b = r.b AND r.i = l.i + k
JOIN z ON z.panel_id = l.panel_id AND z.a = l.a AND z.b = l.b GROUP BY l.panel_id, l.a, l.b, k"""),
    "d16_skewness": w(MOMENTS, f"SELECT panel_id, series, n, {r6('skewness', 'skewness')} FROM moments"),
    "d17_excess_kurtosis": w(MOMENTS, f"SELECT panel_id, series, n, {r6('excess_kurtosis', 'excess_kurtosis')} FROM moments"),
    "g01_jarque_bera_stat": w(MOMENTS, f"SELECT panel_id, series, {r6('n / 6.0::DOUBLE * (skewness * skewness + 0.25 * excess_kurtosis * excess_kurtosis)', 'jb')} FROM moments"),
    "g06_ljung_box_stat": w(ACF, f", s AS (SELECT panel_id, series, max(t) AS n FROM panel GROUP BY ALL) SELECT acf.panel_id, acf.series, {r6('any_value(n) * (any_value(n) + 2.0::DOUBLE) * sum(acf * acf / (n - lag))', 'q')} FROM acf JOIN s ON s.panel_id = acf.panel_id AND s.series = acf.series WHERE lag <= 10 GROUP BY acf.panel_id, acf.series"),
    "g12_joint_jarque_bera": w(MOMENTS, f"""
, j AS (SELECT panel_id, sum(n / 6.0::DOUBLE * (skewness * skewness + 0.25 * excess_kurtosis * excess_kurtosis)) AS stat, count(*) AS k FROM moments GROUP BY panel_id)
SELECT panel_id, {r6('stat', 'stat')}, CAST(2 * k AS INTEGER) AS df, {r6('exp(-stat / 2) * (1 + stat/2 + pow(stat/2, 2)/2 + pow(stat/2, 3)/6 + pow(stat/2, 4)/24)', 'p')} FROM j"""),
    "g16_block_lengths": w(ACF, """
, mean AS (SELECT panel_id, lag, avg(abs(acf)) AS m FROM acf GROUP BY ALL), n AS (SELECT panel_id, max(t) AS n FROM panel GROUP BY panel_id),
low AS (SELECT panel_id, lag, m < 2.0::DOUBLE / sqrt(n) AS low FROM mean JOIN n USING (panel_id)),
run AS (SELECT panel_id, lag, low AND lag(low) OVER o AND lag(low, 2) OVER o AS run FROM low WINDOW o AS (PARTITION BY panel_id ORDER BY lag)),
eff AS (SELECT panel_id, coalesce(min(lag) FILTER (run), 24) AS l_eff FROM run GROUP BY panel_id)
SELECT panel_id, CAST(l_eff AS INTEGER) AS l_eff, CAST(least(greatest(5, ceil(1.5 * l_eff)), n // 2) AS BIGINT) AS b1_acf, CAST(least(greatest(5, ceil(pow(n, 1/3.0::DOUBLE))), n // 2) AS BIGINT) AS b2_t13 FROM eff JOIN n USING (panel_id)"""),
    "flow_theta": w(THETA, f"SELECT ts, to_node, from_node, {r6('theta', 'theta')} FROM theta"),
    "c03_to": w(THETA, f"SELECT ts, from_node AS node, {r6('sum(CASE WHEN to_node <> from_node THEN theta ELSE 0 END) * 20', 'to_idx')} FROM theta GROUP BY ALL"),
    "c04_from": w(THETA, f"SELECT ts, to_node AS node, {r6('sum(CASE WHEN to_node <> from_node THEN theta ELSE 0 END) * 20', 'from_idx')} FROM theta GROUP BY ALL"),
    "c05_net": w(NET, f"SELECT ts, node, {r6('s * 20', 'to_idx')}, {r6('r * 20', 'from_idx')}, {r6('(s - r) * 20', 'net_idx')} FROM net"),
    "c06_tci": w(TCI, f"SELECT ts, {r6('value', 'tci')} FROM tci"),
    "c07_pairwise": w(THETA, f"SELECT x.ts, x.to_node, x.from_node, {r6('x.theta - y.theta', 'pdc')} FROM theta x JOIN theta y ON x.ts = y.ts AND x.to_node = y.from_node AND x.from_node = y.to_node"),
    "c08_sub_network": w(THETA, f"""
, sub AS (SELECT ts, to_node, from_node, theta / CASE WHEN sum(theta) OVER r > 1e-12 THEN sum(theta) OVER r ELSE 1 END AS theta FROM theta
  WHERE to_node IN ('ASIA', 'EUROPE', 'AMERICA') AND from_node IN ('ASIA', 'EUROPE', 'AMERICA') WINDOW r AS (PARTITION BY ts, to_node)),
o AS (SELECT ts, node, sum(s) AS s, sum(r) AS r FROM (SELECT ts, from_node AS node, theta AS s, 0.0 AS r FROM sub WHERE to_node <> from_node
  UNION ALL SELECT ts, to_node, 0.0, theta FROM sub WHERE to_node <> from_node) GROUP BY ALL)
SELECT ts, node, {r6('(s - r) * (100 / 3.0::DOUBLE)', 'net_sub')}, {r6('sum(s) OVER (PARTITION BY ts) * (100 / 3.0::DOUBLE)', 'tci_sub')} FROM o"""),
    "c10_trace_tci": w(THETA, f"SELECT ts, {r6('100 * (1 - sum(CASE WHEN to_node = from_node THEN theta ELSE 0 END) / 5)', 'tci')} FROM theta GROUP BY ts"),
    "n01_as_of_last": as_of("final"),
    "n01_as_of_exact": as_of("CASE WHEN before = wanted THEN before END"),
    "n01_as_of_pad": as_of("coalesce(before, after)"),
    "n01_as_of_backfill": as_of("coalesce(after, before)"),
    "n02_as_of_nearest": as_of("CASE WHEN before IS NULL THEN after WHEN after IS NULL THEN before WHEN date_diff('day', before, wanted) <= date_diff('day', wanted, after) THEN before ELSE after END"),
    "n03_group_map": w(GROUPS, "SELECT n_name AS node, coalesce(grp, 'Otros') AS grp FROM nation LEFT JOIN groups ON node = n_name AND grp <> 'AFRICA'"),
    "n04_group_theta": w(GROUPED, f"SELECT ts, to_node, from_node, {r6('theta', 'theta')} FROM grouped"),
    "n05_node_net": w(NET, f"SELECT ts, node, {r6('s - r', 'net_idx')} FROM net"),
    "n06_roles": w(NET, "SELECT node, count(*) FILTER (s - r > 1e-12) AS emitter, count(*) FILTER (s - r < -1e-12) AS receiver FROM net GROUP BY node"),
    "n07_net_edges": w(EDGES, f"SELECT ts, source, target, {r6('weight', 'weight')} FROM edges WHERE weight > 0.01"),
    "n08_node_significance": w(INDEX, f"SELECT series AS node, ts, {r6('value', 'net_idx')}, {r6('lo', 'lo')}, {r6('hi', 'hi')}, lo > 0 OR hi < 0 AS significant FROM idx"),
    "n09_edge_significance": w(EDGES, f"""
, b AS (SELECT ts, to_node AS i, from_node AS j, d - 0.1 AS lo, d + 0.1 AS hi FROM (
  SELECT x.ts, x.to_node, x.from_node, x.theta - y.theta AS d FROM theta x JOIN theta y ON x.ts = y.ts AND x.to_node = y.from_node AND x.from_node = y.to_node
  WHERE x.to_node < x.from_node AND x.to_node <> 'AFRICA'))
SELECT edges.ts, source, target, {r6('weight', 'weight')}, coalesce(lo > 0 OR hi < 0, true) AS significant
FROM edges LEFT JOIN b ON b.ts = edges.ts AND b.i = least(source, target) AND b.j = greatest(source, target)"""),
    "n10_out_strength": w(EDGES, f"""
, nodes AS (SELECT DISTINCT ts, to_node AS node FROM theta), st AS (SELECT ts, source AS node, sum(weight) AS s FROM edges GROUP BY ALL),
f AS (SELECT nodes.ts, nodes.node, coalesce(s, 0.0) AS s FROM nodes LEFT JOIN st ON st.ts = nodes.ts AND st.node = nodes.node)
SELECT ts, node, {r6('s', 'strength')}, {r6('CASE WHEN max(s) OVER (PARTITION BY ts) > 0 THEN s / max(s) OVER (PARTITION BY ts) ELSE 0 END', 'share')} FROM f"""),
    "n11_relative_weight": w(EDGES, f"SELECT ts, source, target, {r6('weight / max(weight) OVER (PARTITION BY ts)', 'relative')} FROM edges"),
    "n12_relative_over_dates": w(EDGES, f"SELECT ts, source, target, {r6('weight / (SELECT max(weight) FROM edges)', 'relative')} FROM edges"),
    "n13_every_date": w(THETA, "SELECT ts FROM (SELECT ts, row_number() OVER (ORDER BY ts) AS i FROM (SELECT DISTINCT ts FROM theta)) WHERE (i - 1) % 4 = 0"),
    "n14_dated_edges": w(EDGES, f"""
, every AS (SELECT ts FROM (SELECT ts, row_number() OVER (ORDER BY ts) AS i FROM (SELECT DISTINCT ts FROM theta)) WHERE (i - 1) % 4 = 0),
kept AS (SELECT * FROM edges SEMI JOIN every USING (ts) WHERE weight > 0.01)
SELECT ts, source, target, {r6('weight', 'weight')}, {r6('weight / (SELECT max(weight) FROM kept)', 'relative')}, weight > 0.1 AS significant FROM kept"""),
    "n15_group_edges": w(GROUPED, f"""
SELECT x.ts, CASE WHEN x.theta > y.theta THEN x.from_node ELSE x.to_node END AS source, CASE WHEN x.theta > y.theta THEN x.to_node ELSE x.from_node END AS target, {r6('abs(x.theta - y.theta)', 'weight')}
FROM grouped x JOIN grouped y ON x.ts = y.ts AND x.to_node = y.from_node AND x.from_node = y.to_node WHERE x.to_node < x.from_node AND abs(x.theta - y.theta) > 1e-9"""),
    "n16_contributions": w(THETA, f"SELECT ts, to_node, from_node, {r6('100 * theta / CASE WHEN sum(theta) OVER (PARTITION BY ts) = 0 THEN 1 ELSE sum(theta) OVER (PARTITION BY ts) END', 'share')} FROM theta WHERE to_node = 'ASIA' AND from_node <> 'ASIA'"),
    "n17_all_contributions": w(THETA, f"""
, s AS (SELECT ts, to_node, from_node, 100 * theta / CASE WHEN sum(theta) OVER (PARTITION BY ts, to_node) = 0 THEN 1 ELSE sum(theta) OVER (PARTITION BY ts, to_node) END AS share FROM theta),
o AS (SELECT to_node, from_node, CAST(row_number() OVER (PARTITION BY to_node ORDER BY CASE WHEN to_node = from_node THEN 1 ELSE 0 END, round(avg(share), 9) DESC, from_node) AS INTEGER) AS place FROM s GROUP BY to_node, from_node)
SELECT ts, to_node, from_node, {r6('share', 'share')}, place FROM s JOIN o USING (to_node, from_node)"""),
    "t02_kpss": KPSS,
    "t03_phillips_perron": PHILLIPS_PERRON,
    "n01_theta_as_of_panels": w(PANEL_THETA + ", " + REQUESTS.replace("dates AS", "_ignored AS"), f"""
, dates AS (SELECT DISTINCT panel_id, ts FROM theta), asked AS (SELECT * FROM requests, (VALUES ('1-URGENT'), ('5-LOW')) p(panel_id)),
near AS (SELECT asked.panel_id, request, wanted, arg_min(ts, (abs(date_diff('day', ts, wanted)), ts)) AS ts FROM asked JOIN dates USING (panel_id) GROUP BY ALL)
SELECT panel_id, request, wanted, ts, to_node, from_node, {r6('theta', 'theta')} FROM near JOIN theta USING (panel_id, ts)"""),
    "n08_node_significance_panels": w(PANEL_EDGES, f"""
, net AS (SELECT panel_id, ts, from_node AS node, 100 * sum(d) / 5 AS v FROM both_ways GROUP BY ALL)
SELECT panel_id, ts, node, {r6('v', 'net_idx')}, {r6('v - 2', 'lo')}, {r6('v + 2', 'hi')}, v - 2 > 0 OR v + 2 < 0 AS significant FROM net"""),
    "n09_edge_significance_panels": w(PANEL_EDGES, f"""
SELECT e.panel_id, e.ts, source, target, {r6('weight', 'weight')}, coalesce(d - 0.1 > 0 OR d + 0.1 < 0, true) AS significant
FROM edges e LEFT JOIN both_ways b ON b.panel_id = e.panel_id AND b.ts = e.ts AND b.to_node = least(source, target) AND b.from_node = greatest(source, target) AND b.to_node <> 'AFRICA'"""),
    "n10_out_strength_panels": w(PANEL_EDGES, f"""
, nodes AS (SELECT DISTINCT panel_id, ts, to_node AS node FROM theta), st AS (SELECT panel_id, ts, source AS node, sum(weight) AS s FROM edges GROUP BY ALL),
f AS (SELECT nodes.panel_id, nodes.ts, nodes.node, coalesce(s, 0.0) AS s FROM nodes LEFT JOIN st USING (panel_id, ts, node))
SELECT panel_id, ts, node, {r6('s', 'strength')}, {r6('CASE WHEN max(s) OVER (PARTITION BY panel_id, ts) > 0 THEN s / max(s) OVER (PARTITION BY panel_id, ts) ELSE 0 END', 'share')} FROM f"""),
    "n11_relative_weight_panels": w(PANEL_EDGES, f"SELECT panel_id, ts, source, target, {r6('weight / max(weight) OVER (PARTITION BY panel_id, ts)', 'relative')} FROM edges"),
    "n12_relative_over_dates_panels": w(PANEL_EDGES, f"SELECT panel_id, ts, source, target, {r6('weight / max(weight) OVER (PARTITION BY panel_id)', 'relative')} FROM edges"),
    "n13_every_date_panels": w(PANEL_THETA, "SELECT panel_id, ts FROM (SELECT panel_id, ts, row_number() OVER (PARTITION BY panel_id ORDER BY ts) AS i FROM (SELECT DISTINCT panel_id, ts FROM theta)) WHERE (i - 1) % 4 = 0"),
    "n17_all_contributions_panels": w(PANEL_THETA, f"""
, s AS (SELECT panel_id, ts, to_node, from_node, 100 * theta / CASE WHEN sum(theta) OVER r = 0 THEN 1 ELSE sum(theta) OVER r END AS share FROM theta WINDOW r AS (PARTITION BY panel_id, ts, to_node)),
o AS (SELECT panel_id, to_node, from_node, CAST(row_number() OVER (PARTITION BY panel_id, to_node ORDER BY CASE WHEN to_node = from_node THEN 1 ELSE 0 END, round(avg(share), 9) DESC, from_node) AS INTEGER) AS place FROM s GROUP BY panel_id, to_node, from_node)
SELECT panel_id, ts, to_node, from_node, {r6('share', 'share')}, place FROM s JOIN o USING (panel_id, to_node, from_node)"""),
    "n18_pair_names": "SELECT a.n_name AS a, b.n_name AS b, substr(a.n_name, 1, 12) || ' vs ' || substr(b.n_name, 1, 12) AS pair FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey",
    "e01_zones": w(TCI, f"""
, p AS (SELECT quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99 FROM tci WHERE t > 200)
SELECT series, ts, {r6('value', 'value')}, {r6('p95', 'p95')}, {r6('p99', 'p99')}, CASE WHEN value > p99 THEN 'above P99' WHEN value >= p95 THEN 'P95-P99' ELSE 'normal' END AS zone FROM tci, p"""),
    "e02_stable_range": w(INDEX, f"SELECT series, {r6('min(lo) - (max(hi) - min(lo)) * 0.05', 'low')}, {r6('max(hi) + (max(hi) - min(lo)) * 0.05', 'high')} FROM idx WHERE t > 200 GROUP BY series"),
    "e03_sign_class": w(INDEX, f"SELECT series, ts, {r6('value', 'value')}, CASE WHEN lo > 0 THEN 'significant positive' WHEN hi < 0 THEN 'significant negative' WHEN value > 0 THEN 'positive' WHEN value < 0 THEN 'negative' ELSE 'zero' END AS class FROM idx"),
    "e04_periods": w(TCI + ", " + PERIODS, 'SELECT series, ord, start, "end", name FROM (SELECT series, min(ts) AS a, max(ts) AS b FROM tci GROUP BY series) JOIN periods ON start <= b AND "end" >= a'),
    "e05_episodes": w(EPISODES, f"SELECT series, start_date, end_date, duration_days, {r6('max_value', 'max_value')} FROM episodes"),
    "e06_episode_events": w(EPISODES, f"SELECT series, start_date, end_date, duration_days, {r6('max_value', 'max_value')}, events FROM named"),
    "e07_episode_summary": w(EPISODES, f"SELECT series, count(*) AS episodes, count(*) FILTER (events <> '-') AS with_event, {r6('avg(CASE WHEN events <> chr(45) THEN 1.0 ELSE 0.0 END) * 100', 'percent')} FROM named GROUP BY series"),
    "b04_percentiles": f"SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS ts, {r6('quantile_cont(o_totalprice, 0.025)', 'lo')}, {r6('quantile_cont(o_totalprice, 0.975)', 'hi')} FROM orders GROUP BY 1",
}
