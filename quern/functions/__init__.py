"""Predicates and aggregates as Catalyst expressions."""
