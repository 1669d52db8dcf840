"""Independent DuckDB SQL for every analysis (the correctness oracle)."""


def all_sql() -> dict[str, str]:
    import importlib

    out: dict[str, str] = {}
    for mod in ("customers_sql", "sales_sql", "logistics_sql", "market_sql", "feedback_sql", "inference_sql"):
        try:
            m = importlib.import_module(f"oracle.{mod}")
        except ModuleNotFoundError:
            continue
        out.update(m.SQL)
    return out
