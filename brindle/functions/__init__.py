"""Scalar operations as functions from columns to columns.

Arguments are columns or column names; a plain Python number or ``lit`` works
where a parameter is constant.  Invalid input gives NULL unless a docstring
says otherwise, and NULL in gives NULL out.
"""
