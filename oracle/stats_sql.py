"""SQL for the tests, from their definitions: densities integrated by Simpson's rule.

2 units or the standard error is 0; p is the tail in the stated direction.
"""

STEPS = 20000


def integral(density: str, upper: str) -> str:
    """Simpson integral over u from 0 to ``upper`` of ``density`` (an expression in u)."""
    h = f"(({upper}) / {STEPS}.0::DOUBLE)"
    f = density.replace("{u}", f"(i * {h})")
    return (f"(SELECT sum((CASE WHEN i = 0 OR i = {STEPS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * ({f})) * {h} / 3.0::DOUBLE "
            f"FROM (SELECT unnest(range(0, {STEPS + 1})) AS i))")


def tail(density: str, x: str) -> str:
    """P(X > x) of a symmetric density."""
    return f"(0.5::DOUBLE - sign({x}) * {integral(density, f'abs({x})')})"


NORMAL = "exp(-{u} * {u} / 2.0::DOUBLE) / sqrt(2.0::DOUBLE * pi())"


def student(df: str) -> str:
    return (f"exp(lgamma(({df} + 1.0::DOUBLE) / 2.0::DOUBLE) - lgamma({df} / 2.0::DOUBLE)) / sqrt({df} * pi())"
            f" * pow(1.0::DOUBLE + {{u}} * {{u}} / {df}, -({df} + 1.0::DOUBLE) / 2.0::DOUBLE)")


def towards(stat: str, direction: str) -> str:
    return stat if direction == "greater" else f"(-({stat}))"


def welch_select(direction: str) -> str:
    """Select list over columns n1, m1, v1, n2, m2, v2 -> t, df, p_one_sided."""
    a, b = "(v1 / n1)", "(v2 / n2)"
    ok = f"(n1 >= 2 AND n2 >= 2 AND sqrt({a} + {b}) > 0)"
    t = f"(CASE WHEN {ok} THEN (m1 - m2) / sqrt({a} + {b}) END)"
    df = f"(CASE WHEN {ok} THEN ({a} + {b}) * ({a} + {b}) / ({a} * {a} / (n1 - 1) + {b} * {b} / (n2 - 1)) END)"
    p = f"(CASE WHEN {ok} THEN {tail(student(df), towards(t, direction))} END)"
    return f"round({t}, 6) AS t, round({df}, 6) AS df, round({p}, 9) AS p_one_sided"


def two_prop_select(direction: str) -> str:
    """Select list over x1, n1, x2, n2 (counts) -> z, p_one_sided."""
    n1, n2 = "CAST(n1 AS DOUBLE)", "CAST(n2 AS DOUBLE)"
    pooled = f"(CAST(x1 + x2 AS DOUBLE) / ({n1} + {n2}))"
    se = f"sqrt({pooled} * (1.0::DOUBLE - {pooled}) * (1.0::DOUBLE / {n1} + 1.0::DOUBLE / {n2}))"
    ok = f"(n1 >= 2 AND n2 >= 2 AND {se} > 0)"
    z = f"(CASE WHEN {ok} THEN (CAST(x1 AS DOUBLE) / {n1} - CAST(x2 AS DOUBLE) / {n2}) / {se} END)"
    p = f"(CASE WHEN {ok} THEN {tail(NORMAL, towards(z, direction))} END)"
    return f"round({z}, 6) AS z, round({p}, 9) AS p_one_sided"


def chi2_tail(x: str, k: str) -> str:
    """P(X > x) for k degrees of freedom; u = v * v takes the pole at 0 away."""
    density = (f"2.0::DOUBLE * pow({{u}}, {k} - 1) * exp(-{{u}} * {{u}} / 2.0::DOUBLE)"
               f" / (pow(2.0::DOUBLE, {k} / 2.0::DOUBLE) * gamma({k} / 2.0::DOUBLE))")
    return f"(1.0::DOUBLE - {integral(density, f'sqrt({x})')})"
