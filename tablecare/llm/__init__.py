"""Operators of a training-data pipeline over text tables.

Nothing else in the library imports this subpackage.  Every operator takes a
DataFrame and the names of the columns it reads, selects only those (further
columns, whatever their names, never reach it) and returns a DataFrame.
"""
