"""Analytical operators: DataFrame -> DataFrame functions."""
