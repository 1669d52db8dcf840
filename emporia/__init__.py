"""emporia: marketplace analytics expressed as Spark DataFrame plans.

Every analysis is a function ``f(t: Roles, **params) -> DataFrame`` over a
small set of *role* tables (customer, order, item, product, payment, review,
seller, geo).  Bindings in :mod:`emporia.sources` map physical tables to
roles; :mod:`emporia.plans` holds the shared order-grain bases and the SQL
surface; :mod:`emporia.operators` holds the analyses themselves.
"""

from emporia.sources.roles import Roles, bind_testdata

__all__ = ["Roles", "bind_testdata"]
