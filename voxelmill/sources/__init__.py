"""Readers and writers for imaging files and archives."""
