"""Operators on trace tables (trace_id, x array, y array) and on the tables derived from them."""
