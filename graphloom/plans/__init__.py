"""Registered queries and the graphs that they run over."""
