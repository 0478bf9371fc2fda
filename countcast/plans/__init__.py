"""Whole flows: training and comparing models, scoring request tables, what-if runs."""
