"""Queries over the driver's tables, one per operator, each with the SQL that must give the same rows."""
