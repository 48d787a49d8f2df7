"""Registered queries of the document and invoice operators, and their SQL."""

from . import cleaning, grids, invoices, layouts, operations, readings

QUERIES = cleaning.QUERIES | invoices.QUERIES | operations.QUERIES | layouts.QUERIES | readings.QUERIES | grids.QUERIES
ORACLES = cleaning.ORACLES | invoices.ORACLES | operations.ORACLES | layouts.ORACLES | readings.ORACLES | grids.ORACLES
