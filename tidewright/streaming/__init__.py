"""Stateful processors for continuous queries."""
