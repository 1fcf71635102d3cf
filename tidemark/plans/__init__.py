"""Registered queries: every operator bound to the driver's tables, with the SQL that checks it."""
