"""Readers and writers of sequence, graph and alignment files."""
