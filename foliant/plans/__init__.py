"""Compositions of functions and operators into whole jobs."""
