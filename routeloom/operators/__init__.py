"""Operators over DataFrames: sequences, coverage, versions, observations, space, schedules, graphs."""
