"""SQL surface (X3): role tables and analyses as temporary views.

``register_views(t)`` exposes each role as ``r_<role>`` and, on request, each
analysis as ``a_<name>``, so analyses can be written or consumed as Spark SQL
(which accepts most HiveQL).  Views are lazy, registering them starts no job:
a query over ``a_<name>`` plans the same DataFrame as calling the analysis
function, but for the analyses in ``EAGER``, whose global ranking stores a
table when it is called; their views are the SQL text below, which ranks by
a histogram of values and by ranges inside one value, so no task gets all rows.

``SPARK_SQL`` holds every analysis as SQL text over the role views; tests check
they agree with the DataFrame versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emporia.plans.sql_text import SPARK_SQL, create_functions
from emporia.sources.roles import ROLE_COLUMNS, Roles


def register_views(t: Roles, analyses: bool = False) -> list[str]:
    """Create ``r_<role>`` views (and ``a_<analysis>`` views if asked)."""
    names = []
    create_functions(t.order.sparkSession)
    for role in ROLE_COLUMNS:
        getattr(t, role).createOrReplaceTempView(f"r_{role}")
        names.append(f"r_{role}")
    if analyses:
        from emporia.plans.catalog import ANALYSES

        for name, analysis in ANALYSES.items():
            df = t.order.sparkSession.sql(SPARK_SQL[name]) if name in EAGER else analysis.run(t)
            df.createOrReplaceTempView(f"a_{name}")
            names.append(f"a_{name}")
    return names


EAGER = {"seller_bad_review_concentration"}


def run_sql(spark: SparkSession, t: Roles, text: str) -> DataFrame:
    """Register the role views and run SQL text over them."""
    register_views(t)
    return spark.sql(text)
