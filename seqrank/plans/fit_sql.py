"""SQL of small linear algebra, for the SQL that fits are held against."""

from __future__ import annotations


def solved(source: str, n: int) -> str:
    """A query's rows with x0, x1, ...: the solution of a symmetric positive system (a0_0, a0_1, ... of i <= j, and b0, b1, ...).

    Each step is a query around the one before, so that no expression holds another twice.
    """
    levels = []
    for j in range(n):
        levels.append([f"a{j}_{j}" + "".join(f" - l{j}_{k} * l{j}_{k} * d{k}" for k in range(j)) + f" AS d{j}"])
        levels.append([f"(a{j}_{i}" + "".join(f" - l{i}_{k} * l{j}_{k} * d{k}" for k in range(j)) + f") / d{j} AS l{i}_{j}" for i in range(j + 1, n)])
    levels += [[f"b{i}" + "".join(f" - l{i}_{k} * y{k}" for k in range(i)) + f" AS y{i}"] for i in range(n)]
    levels += [[f"y{i} / d{i}" + "".join(f" - l{k}_{i} * x{k}" for k in range(i + 1, n)) + f" AS x{i}"] for i in reversed(range(n))]
    for level in filter(None, levels):
        source = f"SELECT *, {', '.join(level)} FROM ({source})"
    return source


def ridge(rows: str, columns: list[str], target: str, key: str = "f", alpha: float = 1.0) -> str:
    """A query with a row per key: w0, w1, ... (over the raw columns) and intercept."""
    n = len(columns)
    stats = [f"count(*) AS n, avg({target}) AS my"]
    for i, c in enumerate(columns):
        stats.append(f"avg({c}) AS m{i}, sqrt(var_pop({c})) AS s{i}, covar_pop({c}, {target}) AS c{i}")
        stats += [f"covar_pop({c}, {columns[j]}) AS v{i}_{j}" for j in range(i, n)]
    system = [f"n * v{i}_{j} / (s{i} * s{j})" + (f" + {alpha}::DOUBLE" if i == j else "") + f" AS a{i}_{j}" for i in range(n) for j in range(i, n)]
    system += [f"n * c{i} / s{i} AS b{i}" for i in range(n)]
    weights = [f"x{i} / s{i} AS w{i}" for i in range(n)]
    intercept = "my - " + " - ".join(f"w{i} * m{i}" for i in range(n)) + " AS intercept"
    found = solved(f"SELECT *, {', '.join(system)} FROM (SELECT {key}, {', '.join(stats)} FROM {rows} GROUP BY {key})", n)
    return f"SELECT {key}, {', '.join(f'w{i}' for i in range(n))}, {intercept} FROM (SELECT *, {', '.join(weights)} FROM ({found}))"


def logistic(rows: str, columns: list[str], label: str, key: str = "f", steps: int = 12) -> str:
    """CTEs that end in ``fitted``: a row per key with w0, w1, ... and intercept. rows: a table of key, label and columns.

    Balanced weights, penalty 1 on the weights of features standardised by their population sd, Newton steps from 0.
    """
    n = len(columns)
    d = n + 1
    stats = ", ".join(f"avg({c}) AS m{i}, sqrt(var_pop({c})) AS s{i}" for i, c in enumerate(columns, 1))
    z = ", ".join(f"({c} - m{i}) / (CASE WHEN s{i} > 0 THEN s{i} ELSE 1 END) AS z{i}" for i, c in enumerate(columns, 1))
    out = [
        f"st AS (SELECT {key}, count(*)::DOUBLE AS n, sum({label})::DOUBLE AS p, {stats} FROM {rows} GROUP BY {key})",
        f"z AS MATERIALIZED (SELECT {key}, {label} AS y, CASE WHEN {label} = 1 THEN n / (2 * p) ELSE n / (2 * (n - p)) END AS wt, 1::DOUBLE AS z0, {z} FROM {rows} JOIN st USING ({key}))",
        f"t0 AS (SELECT {key}, {', '.join(f'0::DOUBLE AS t{i}' for i in range(d))} FROM st)",
    ]
    score = " + ".join(f"t{i} * z{i}" for i in range(d))
    sums = [f"sum(wt * (p - y) * z{i}) + {int(i > 0)} * any_value(t{i}) AS b{i}" for i in range(d)]
    sums += [f"sum(wt * p * (1 - p) * z{i} * z{j})" + (" + 1" if i == j and i else "") + f" AS a{i}_{j}" for i in range(d) for j in range(i, d)]
    for k in range(steps):
        moment = f"SELECT {key}, {', '.join(f'any_value(t{i}) AS t{i}' for i in range(d))}, {', '.join(sums)} FROM (SELECT *, 1 / (1 + exp(-({score}))) AS p FROM z JOIN t{k} USING ({key})) GROUP BY {key}"
        out.append(f"t{k + 1} AS MATERIALIZED (SELECT {key}, {', '.join(f't{i} - x{i} AS t{i}' for i in range(d))} FROM ({solved(moment, d)}))")
    weights = [f"t{i} / s{i} AS w{i - 1}" for i in range(1, d)]
    intercept = "t0 - " + " - ".join(f"t{i} / s{i} * m{i}" for i in range(1, d)) + " AS intercept"
    out.append(f"fitted AS (SELECT {key}, {', '.join([*weights, intercept])} FROM t{steps} JOIN st USING ({key}))")
    return ", ".join(out)


def dealt(rows: str, group: str, k: int = 5) -> str:
    """CTEs that end in ``dealt`` (group, fold): groups, the largest first, each to the lightest of k folds. Needs WITH RECURSIVE."""
    lightest = "CASE " + " ".join(f"WHEN {' AND '.join(f'w{f} <= w{g}' for g in range(k) if g != f)} THEN {f}" for f in range(k)) + " END"
    after = ", ".join(f"w{f} + CASE WHEN fold = {f} THEN n ELSE 0 END AS w{f}" for f in range(k))
    zero = ", ".join(f"0::BIGINT AS w{f}" for f in range(k))
    weights = ", ".join(f"w{f}" for f in range(k))
    return (
        f"sized AS MATERIALIZED (SELECT {group}, n, row_number() OVER (ORDER BY n DESC, {group}::VARCHAR) AS r FROM (SELECT {group}, count(*) AS n FROM {rows} GROUP BY {group})), "
        f"deal AS (SELECT 0::BIGINT AS r, 0 AS fold, {zero} UNION ALL SELECT r, fold, {after} FROM (SELECT sized.r, sized.n, {lightest} AS fold, {weights} FROM deal JOIN sized ON sized.r = deal.r + 1)), "
        f"dealt AS (SELECT {group}, fold FROM sized JOIN deal USING (r))"
    )
