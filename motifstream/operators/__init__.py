"""Operators on labelled graphs, all of them DataFrame expressions."""
