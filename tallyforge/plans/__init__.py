"""Metric views."""
