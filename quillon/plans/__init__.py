"""Queries over the driver's tables, one or more for every operator.

``quillon.plans.catalog`` imports them all; the
syntax modules here do without them.
"""
