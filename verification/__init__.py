"""Equivalent SQL of the registered queries, used only to check results."""
