"""Relational operators over study, series, image and task tables."""
