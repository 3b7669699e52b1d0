"""Queries over the standard tables, one or more per operator, each with equivalent SQL.

Clean input shows nothing of a cleaning operator, so many queries start from a view with nulls,
case variants or padding derived from the table by a fixed rule, in the same SQL on both sides.
"""
