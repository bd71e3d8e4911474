"""Operators applied to the driver's tables, each with its SQL counterpart where there is one."""
