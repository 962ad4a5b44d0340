"""Operators on subjects, items, subsets and their incidence."""
