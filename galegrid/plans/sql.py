"""SQL equivalents of the queries, as DuckDB runs them; common table expressions are shared."""

from __future__ import annotations

import re

from ..operators.stencil import gaussian_weights

CTES = {
    "e": "SELECT vec_id, unnest(embedding)::DOUBLE AS e, (generate_subscripts(embedding, 1) - 1)::INT AS pos FROM embeddings",
    "grid8": "SELECT vec_id::INT AS t, pos // 8 AS y, pos % 8 AS x, 250 + 60 * e AS v FROM e",
    "whole": "SELECT vec_id // 64 AS t FROM embeddings GROUP BY 1 HAVING count(*) = 64",
    "grid64": "SELECT (vec_id // 64)::INT AS t, (vec_id % 64)::INT AS y, pos AS x, 250 + 60 * e AS v FROM e WHERE vec_id // 64 IN (SELECT t FROM whole)",
    "grid_missing": "SELECT t, y, x, CASE WHEN (7 * t + 31 * y + 17 * x) % 11 <> 0 THEN v END AS v FROM grid64",
    "grid_cores": """SELECT t, y, x, 285 + 20 * ((v - 250) / 60)
        - 70 * exp(-((y - 18 - 2 * (t % 7)) ** 2 + (x - 16 - 2 * (t % 7)) ** 2) / 128.0)
        - 70 * exp(-((y - 46 + t % 7) ** 2 + (x - 47) ** 2) / 128.0) AS v FROM grid64""",
    "points": "SELECT event_id AS point_id, (event_id % 7)::INT AS t, (event_id % 64)::INT AS y, (event_id * 13 % 64)::INT AS x FROM events",
    "obs": """SELECT user_id::INT AS storm_idx, event_id, event_type AS nature, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS obs_idx,
        CASE WHEN event_id % 11 <> 0 THEN value END AS usa_wind, event_id % 61 * 0.25 - 7.5 AS lat, event_id * 7 % 59 * 0.25 - 7.25 AS lon FROM events""",
    "observations": """SELECT *, strftime(TIMESTAMP '2022-09-01' + to_hours(3 * obs_idx::INT), '%Y-%m-%d %H:%M:%S') AS iso_time, (6 * obs_idx)::INT AS tick FROM obs""",
    "storms": """SELECT storm_idx, 2000 + storm_idx % 20 AS season, upper(arg_min(nature, obs_idx)) AS name, count(*) AS numobs FROM observations GROUP BY storm_idx""",
    "quads": """SELECT l_orderkey AS storm_idx, 6 * (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) - 1) AS tick,
        [l_quantity / 1.0, l_extendedprice / 1000.0, l_discount / 0.01, l_tax / 0.01] AS radii FROM lineitem""",
    "land": "SELECT i // 64 AS y, i % 64 AS x, i % 5 = 0 AS is_land FROM range(4096) r(i)",
}

FLAT_OR = "CASE WHEN dy IS NULL OR dx IS NULL THEN NULL WHEN dy = 0 AND dx = 0 THEN 180.0 ELSE (degrees(atan2(dy, -dx)) + 360) % 360 END"
COARSE = "CASE WHEN {y} = 0 AND {x} = 0 THEN 0.0 ELSE (57.29578 * atan2({y}, {x}) + 360) % 360 END"
FOLD = "CASE WHEN {d} < -270 THEN {d} + 360 WHEN {d} < -90 THEN -({d}) - 180 WHEN {d} > 270 THEN {d} - 360 WHEN {d} > 90 THEN 180 - ({d}) ELSE {d} END"
WRAP = "CASE WHEN {d} < -270 THEN {d} + 360 WHEN {d} < -90 THEN {d} + 180 WHEN {d} > 270 THEN {d} - 360 WHEN {d} > 90 THEN {d} - 180 ELSE {d} END"


def disc(r: int) -> str:
    return f"""SELECT dy, dx, CASE WHEN dy = 0 AND dx = 0 THEN 0.0 ELSE (degrees(atan2(-dy, dx)) + 360) % 360 END AS ray
        FROM range(-{r}, {r}) a(dy), range(-{r}, {r}) b(dx) WHERE dy * dy + dx * dx < {r * r}"""


def half_disc(r: int) -> str:
    return f"""SELECT dy, dx, {COARSE.format(y="(dy + 0.5)", x="(dx + 0.5)")} AS ray FROM range(-{r}, {r}) a(dy), range(-{r}, {r}) b(dx)
        WHERE (dy + 0.5) ** 2 + (dx + 0.5) ** 2 <= {r * r}"""


def differences(source: str) -> str:
    def one(w: str) -> str:
        return f"""CASE WHEN lag(y) OVER {w} IS NULL THEN lead(v) OVER {w} - v WHEN lead(y) OVER {w} IS NULL THEN v - lag(v) OVER {w}
            ELSE (lead(v) OVER {w} - lag(v) OVER {w}) / 2 END"""

    return f"SELECT t, y, x, {one('down')} AS dy, {one('across')} AS dx FROM {source} WINDOW down AS (PARTITION BY t, x ORDER BY y), across AS (PARTITION BY t, y ORDER BY x)"


def angles(source: str) -> str:
    return f"SELECT t, y, x, {FLAT_OR} AS g FROM ({differences(source)})"


def taps(weights: list[float]) -> str:
    h = len(weights) // 2
    return "(VALUES " + ", ".join(f"({k - h}, {w!r}::DOUBLE)" for k, w in enumerate(weights) if w) + ") taps(k, w)"


def filtered(source: str, along: str, side: int, weights: list[float], edge: str = "reflect", whole: bool = False) -> str:
    """Gathers: each cell sums its taps' cells."""
    i = f"g.{along} + k"
    m = f"((({i}) % {2 * side}) + {2 * side}) % {2 * side}"
    index = f"CASE WHEN {m} < {side} THEN {m} ELSE {2 * side - 1} - {m} END" if edge == "reflect" else f"least(greatest({i}, 0), {side - 1})"
    other = "x" if along == "y" else "y"
    total = "sum(w * s.v)"
    return f"""SELECT g.t, g.y, g.x, {f"trunc({total})" if whole else total} AS v FROM {source} g, {taps(weights)} JOIN {source} s
        ON s.t = g.t AND s.{other} = g.{other} AND s.{along} = {index} GROUP BY ALL"""


def blurred(source: str, name: str, side: int, edge: str = "reflect", whole: bool = False) -> dict[str, str]:
    w = gaussian_weights(2.0)
    return {f"{name}_down": filtered(source, "y", side, w, edge, whole), name: filtered(f"{name}_down", "x", side, w, edge, whole)}


def sobels(source: str, side: int, whole: bool = False) -> dict[str, str]:
    step, smooth = [-1.0, 0.0, 1.0], [1.0, 2.0, 1.0]
    return {
        "dy_1": filtered(source, "y", side, step, whole=whole), "dy_2": filtered("dy_1", "x", side, smooth, whole=whole),
        "dx_1": filtered(source, "y", side, smooth, whole=whole), "dx_2": filtered("dx_1", "x", side, step, whole=whole),
        "sobels": "SELECT t, y, x, a.v AS dy, b.v AS dx FROM dy_2 a JOIN dx_2 b USING (t, y, x)",
    }


def variance(g: str, r: int, centres: str) -> str:
    d = FOLD.format(d="(n.g - ray)")
    return f"""SELECT c.t, c.y, c.x, var_samp({d}) AS dav FROM {centres} c CROSS JOIN ({disc(r)}) o
        LEFT JOIN {g} n ON n.t = c.t AND n.y = c.y + dy AND n.x = c.x + dx GROUP BY ALL"""


def filled(source: str, width: int) -> str:
    return f"""SELECT t, y, x, CASE WHEN v IS NOT NULL THEN v WHEN a IS NULL THEN b.v WHEN b IS NULL THEN a.v
            ELSE a.v + (b.v - a.v) * (p - a.p) / (b.p - a.p) END AS v
        FROM (SELECT *, last_value(k IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
                     first_value(k IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b
              FROM (SELECT *, y * {width} + x AS p, CASE WHEN v IS NOT NULL THEN {{'p': y * {width} + x, 'v': v}} END AS k FROM {source})
              WINDOW w AS (PARTITION BY t ORDER BY p))"""


CORES_DAV = {"g": angles("cores_blur"), "dav": variance("g", 10, "grid_cores")}


def query(columns: str, body: str, recursive: bool = False, **ctes: str) -> str:
    """SELECT of columns (name:kind, kinds i whole, v double with 4 decimals, w with 8, s as is) from body, with the tables it needs before it."""
    every = CTES | ctes
    needed, order = set(), []

    def visit(text: str) -> None:
        for name in every:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(every[name])
                order.append(name)

    visit(body)
    kinds = {"i": "{0}::BIGINT AS {0}", "v": "round({0}, 4) + 0.0 AS {0}", "w": "round({0}, 8) + 0.0 AS {0}", "s": "{0}"}
    shown = ", ".join(kinds[k].format(c) for c, k in (x.split(":") for x in columns.split()))
    with_ = ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(f"{n} AS ({every[n]})" for n in order)
    return (f"{with_}\n" if order else "") + f"SELECT {shown} FROM ({body})"


