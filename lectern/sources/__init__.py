"""Readers for learner exports and writers for result tables."""
