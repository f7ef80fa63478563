"""Views of the given tables as traces, and the registered queries."""
