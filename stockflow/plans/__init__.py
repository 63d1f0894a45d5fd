"""The named queries and the SQL they are checked against."""

from . import admin, forecasts, lookups, orders, scenarios, stock, vendors, worklists

MODULES = (stock, vendors, forecasts, lookups, orders, admin, scenarios, worklists, lookups)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
