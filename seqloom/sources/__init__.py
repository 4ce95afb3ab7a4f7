"""Readers of sequences, intensities, peaks, answers and motif files."""
