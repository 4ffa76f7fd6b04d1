"""SQL building blocks for the registered queries: the measures as nested list folds."""

from __future__ import annotations

from tempora.plans.tables import SQL

INF = "'inf'::DOUBLE"


def series(name: str) -> str:
    return f"s AS ({SQL[name]})"


def pairs(name: str, condition: str = "x.id < y.id") -> str:
    return f"{series(name)}, p AS (SELECT x.id AS i, y.id AS j, x.v AS a, y.v AS b FROM s x JOIN s y ON {condition})"


def last_row(a: str = "a", b: str = "b", cost: str = "(x - y) ** 2", penalty: float = 0.0, window: int | None = None, max_step: float | None = None, skip: int | str = 0) -> str:
    """The last row of the cost table, border first. cost in x and y; skip: points of b that may be left out at its begin."""
    j = "q[1]::INT"
    x, y = "cur[1]", f"{b}[{j}]"
    d = "(" + cost.replace("x", "\0").replace("y", y).replace("\0", x) + ")"
    best = f"least(prev[{j}], prev[{j} + 1] + {penalty}, list_last(row) + {penalty})"
    cell = f"{d} + {best}"
    if max_step is not None:
        cell = f"CASE WHEN {d} > {max_step} THEN {INF} ELSE {cell} END"
    if window:
        n, m, i0, j0 = f"len({a})", f"len({b})", "(cur[2] - 1)", f"({j} - 1)"
        cell = f"CASE WHEN {j0} >= {i0} - greatest(0, {n} - {m}) - {window} + 1 AND {j0} < {i0} + greatest(0, {m} - {n}) + {window} THEN {cell} ELSE {INF} END"
    first = f"list_prepend(0.0::DOUBLE, list_transform(range(1, len({b}) + 1), lambda k: CASE WHEN k <= {skip} THEN 0.0::DOUBLE ELSE {INF} END))"
    return f"list_reduce(list_transform({a}, lambda x, i: [x::DOUBLE, i::DOUBLE]), lambda prev, cur: list_reduce(list_transform(range(1, len({b}) + 1), lambda k: [k::DOUBLE]), lambda row, q: list_append(row, {cell}), [{INF}]), {first})"


def nested_last_row(d: str) -> str:
    """As last_row, over series of points: the cost d is in cur (a point) and y (a point)."""
    cell = f"{d} + least(prev[q[1]::INT], prev[q[1]::INT + 1], list_last(row))"
    return f"list_reduce(list_transform(a, lambda x: x), lambda prev, cur: list_reduce(list_transform(range(1, len(b) + 1), lambda k: [k::DOUBLE]), lambda row, q: list_append(row, {cell}), [{INF}]), list_prepend(0.0::DOUBLE, list_transform(b, lambda x: {INF})))"


def all_pairs(name: str, value: str, column: str = "distance", condition: str = "x.id < y.id", where: str = "") -> str:
    return f"WITH {pairs(name, condition)} SELECT i, j, round({value}, 6) AS {column} FROM p{where}"


#: A distance's cost table in full, border first: rows of a list of lists.
TABLE = f"list_reduce(list_transform(a, lambda x: [[x::DOUBLE]]), lambda made, cur: list_append(made, list_reduce(list_transform(range(1, len(b) + 1), lambda k: [k::DOUBLE]), lambda row, q: list_append(row, (cur[1][1] - b[q[1]::INT]) * (cur[1][1] - b[q[1]::INT]) + least(list_last(made)[q[1]::INT], list_last(made)[q[1]::INT + 1], list_last(row))), [{INF}])), [list_prepend(0.0::DOUBLE, list_transform(b, lambda x: {INF}))])"


def best_paths(source: str) -> str:
    """CTEs up to w (i, j, k, r, c): steps of the cheapest paths of source's pairs (i, j, a, b), from 1, the last step first."""
    diagonal, up, left = "t[r][c]", "t[r][c + 1]", "t[r + 1][c]"
    corner = f"{diagonal} <= {up} AND {diagonal} <= {left}"
    return f"""t AS MATERIALIZED (SELECT i, j, a, b, {TABLE} AS t FROM {source}),
w AS (SELECT i, j, 0 AS k, len(a) AS r, len(b) AS c FROM t UNION ALL
SELECT w.i, w.j, k + 1, CASE WHEN {corner} OR {up} <= {left} THEN r - 1 ELSE r END, CASE WHEN {corner} OR NOT {up} <= {left} THEN c - 1 ELSE c END FROM w JOIN t ON w.i = t.i AND w.j = t.j WHERE r > 1 AND c > 1 OR r = 1 AND c > 1 AND NOT ({corner} OR {up} <= {left}) OR c = 1 AND r > 1 AND NOT ({corner}) AND {up} <= {left})"""
