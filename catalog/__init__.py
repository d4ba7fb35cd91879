"""Every operator as a query over the given tables, with an independent SQL twin."""

from catalog import sources, filters, scalars, reports, clusters, places, documents  # noqa: F401
