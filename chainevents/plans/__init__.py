"""Whole jobs: the sync run, the query front door and the registered queries."""
