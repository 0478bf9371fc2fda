"""Fact tables, request tables, fitted models and their registry."""
