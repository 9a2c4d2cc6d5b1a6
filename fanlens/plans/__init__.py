"""Wiring: the per-dataset model of derived relations and the query registry."""
