"""Named queries, each with the SQL that checks it."""

from repolith.plans import code, data, delivery, graphs, metrics, reports, search

ALL = [data, reports, code, metrics, delivery, graphs, search]
