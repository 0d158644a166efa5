"""Reads as a stream."""
