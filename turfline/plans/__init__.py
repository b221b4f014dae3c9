"""Whole plans: the adapter of star tables to runners, feature tables, scoring, and the registered queries."""
