"""Whole computations: facts to views, scores to reports."""
