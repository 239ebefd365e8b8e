"""Set-at-a-time operators of ordered tables."""

from keyloom.operators.table import OrderedTable

__all__ = ["OrderedTable"]
