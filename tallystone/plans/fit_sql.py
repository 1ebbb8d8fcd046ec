"""Newton's method as SQL, for the answers that fits are held to: common table expressions that repeat a step of weighted sums and elimination."""

from __future__ import annotations


def _layers(inner: str, keys: str, carried: list[str], m: int) -> str:
    """Solve h s = g for s by elimination: one nested selection for each column, forth and back. Columns: h<i>_<j>, g<i>."""
    h = lambda i, j: f"h{i}_{j}"
    for c in range(m - 1):
        rest = [f"{h(i, j)} - {h(i, c)} / {h(c, c)} * {h(c, j)} AS {h(i, j)}" for i in range(c + 1, m) for j in range(c + 1, m)]
        rest += [f"g{i} - {h(i, c)} / {h(c, c)} * g{c} AS g{i}" for i in range(c + 1, m)]
        kept = [h(i, j) for i in range(c + 1) for j in range(i, m)] + [f"g{i}" for i in range(c + 1)]
        inner = f"SELECT {keys}, {', '.join(carried + kept + rest)} FROM ({inner}) AS e{c}"
    for c in range(m - 1, -1, -1):
        known = "".join(f" - {h(c, j)} * s{j}" for j in range(c + 1, m))
        kept = [h(i, j) for i in range(c) for j in range(i, m)] + [f"g{i}" for i in range(c)] + [f"s{j}" for j in range(c + 1, m)]
        inner = f"SELECT {', '.join([keys, *carried, *kept])}, (g{c}{known}) / {h(c, c)} AS s{c} FROM ({inner}) AS b{c}"
    return inner


def newton(name: str, rows: str, keys: list[str], k: int, penalty: float, rounds: int = 25) -> str:
    """`name` (keys, b0 ... bk; the constant last) of rows (keys, x0 ... x<k-1>, y, w), from zeros."""
    m, key = k + 1, ", ".join(keys)
    x = [f"x{i}" for i in range(k)] + ["1.0"]
    z = " + ".join([*(f"b{i} * x{i}" for i in range(k)), f"b{k}"])
    ridge = [penalty] * k + [1e-12]
    sums = [f"sum(r * {x[i]}) + {ridge[i]!r} * any_value(b{i}) AS g{i}" for i in range(m)]
    sums += [f"sum(c * {x[i]} * {x[j]})" + (f" + {ridge[i] + 1e-12!r}" if i == j else "") + f" AS h{i}_{j}" for i in range(m) for j in range(m)]
    held = [f"b{i}" for i in range(m)]
    inner = f"""SELECT {key}, it, {", ".join(f"any_value({b}) AS {b}" for b in held)}, {", ".join(sums)} FROM (
  SELECT {key}, it, {", ".join([*held, *x[:k]])}, w * (p - y) AS r, w * p * (1 - p) AS c FROM (
    SELECT f.it, {", ".join(f"f.{b}" for b in held)}, q.*, 1 / (1 + exp(-greatest(least({z}, 500.0), -500.0))) AS p FROM {name}_steps AS f JOIN {rows} AS q USING ({key}) WHERE f.it < {rounds}) AS u) AS t
GROUP BY {key}, it"""
    solved = _layers(inner, key, ["it", *held], m)
    return f"""{name}_steps AS (SELECT DISTINCT {key}, 0 AS it, {", ".join(f"0.0::DOUBLE AS {b}" for b in held)} FROM {rows} UNION ALL
SELECT {key}, it + 1, {", ".join(f"b{i} - s{i}" for i in range(m))} FROM ({solved}) AS solved),
{name} AS (SELECT {key}, {", ".join(held)} FROM {name}_steps WHERE it = {rounds})"""


def fits(name: str, rows: str, keys: list[str], features: list[str], weight: str = "1.0") -> str:
    """`name` (keys, n, ones, m<i>, d<i>, b<i>) of rows (keys, features, y): standardised features, balanced classes, a penalty of 1."""
    key, k = ", ".join(keys), len(features)
    moments = ", ".join(f"avg({f}) AS m{i}, CASE WHEN stddev_pop({f}) > 0 THEN stddev_pop({f}) ELSE 1 END AS d{i}" for i, f in enumerate(features))
    placed = ", ".join(f"({f} - m{i}) / d{i} AS x{i}" for i, f in enumerate(features))
    return f"""{name}_n AS (SELECT {key}, count(*) AS n, sum(y) AS ones, {moments} FROM {rows} GROUP BY {key} HAVING sum(y) BETWEEN 1 AND count(*) - 1),
{name}_x AS (SELECT {key}, {placed}, y, {weight} * CASE WHEN y = 1 THEN n / (2.0 * ones) ELSE n / (2.0 * (n - ones)) END AS w FROM {rows} JOIN {name}_n USING ({key})),
{newton(f"{name}_b", f"{name}_x", keys, k, 1.0)},
{name} AS (SELECT * FROM {name}_n JOIN {name}_b USING ({key}))"""


def margin(features: list[str]) -> str:
    """Over rows beside their model, the constant first, as the engine adds them."""
    return " + ".join([f"b{len(features)}", *(f"({f} - m{i}) / d{i} * b{i}" for i, f in enumerate(features))])


def calibrated(name: str, rows: str, keys: list[str], features: list[str], least_rows: int = 1) -> str:
    """`name` (as `fits`, with all and all_ones of every row, slope, level) of rows (keys, features, y, rank from 0 in time): the first four fifths fit, the rest calibrates."""
    key = ", ".join(keys)
    own = ", ".join(f"late.{k}" for k in keys)
    odds = f"least(greatest(1 / (1 + exp(-({margin(features)}))), 1e-9), 1 - 1e-9)"
    return f"""{name}_all AS (SELECT {key}, count(*) AS everyone, sum(y) AS all_ones, greatest(CAST(floor(0.8 * count(*)) AS BIGINT), 10) AS half FROM {rows} GROUP BY {key} HAVING count(*) >= {least_rows}),
{name}_two AS (SELECT {key}, count(*) FILTER (rank >= half) AS n_late, sum(y) FILTER (rank >= half) AS late_ones, sum(y) FILTER (rank < half) AS early_ones, any_value(half) AS half FROM {rows} JOIN {name}_all USING ({key}) GROUP BY {key}),
{name}_cut AS (SELECT {key}, CASE WHEN late_ones > 0 AND late_ones < n_late AND early_ones > 0 AND early_ones < half THEN half ELSE half + n_late + 10 END AS cut FROM {name}_two),
{name}_early AS (SELECT r.* FROM {rows} AS r JOIN {name}_cut USING ({key}) WHERE rank < cut),
{fits(f"{name}_fit", f"{name}_early", keys, features)},
{name}_odds AS (SELECT {own}, late.y, 1.0 AS w, ln(p / (1 - p)) AS x0 FROM (SELECT r.*, {odds} AS p FROM {rows} AS r JOIN {name}_cut USING ({key}) JOIN {name}_fit USING ({key}) WHERE rank >= cut) AS late),
{newton(f"{name}_line", f"{name}_odds", keys, 1, 1e-6, 40)},
{name}_level AS (SELECT {key}, 0 AS it, -30.0::DOUBLE AS lo, 30.0::DOUBLE AS hi FROM {name}_line WHERE b0 <= 0 UNION ALL
SELECT {key}, it + 1, CASE WHEN more THEN mid ELSE lo END, CASE WHEN more THEN hi ELSE mid END FROM (
  SELECT {key}, it, any_value(lo) AS lo, any_value(hi) AS hi, any_value((lo + hi) / 2) AS mid, avg(1 / (1 + exp(-(x0 + (lo + hi) / 2)))) < avg(y) AS more
  FROM {name}_level JOIN {name}_odds USING ({key}) WHERE it < 100 GROUP BY {key}, it) AS halved),
{name} AS (SELECT f.*, everyone, all_ones, CASE WHEN c.b0 IS NULL OR c.b0 <= 0 THEN 1.0 ELSE c.b0 END AS slope, CASE WHEN c.b0 IS NULL THEN 0.0 WHEN c.b0 <= 0 THEN (lo + hi) / 2 ELSE c.b1 END AS level
  FROM {name}_fit AS f JOIN {name}_all USING ({key}) LEFT JOIN {name}_line AS c USING ({key}) LEFT JOIN (SELECT * FROM {name}_level WHERE it = 100) AS v USING ({key}))"""


def probability(features: list[str]) -> str:
    p = f"least(greatest(1 / (1 + exp(-({margin(features)}))), 1e-9), 1 - 1e-9)"
    return f"1 / (1 + exp(-(slope * ln(({p}) / (1 - ({p}))) + level)))"
