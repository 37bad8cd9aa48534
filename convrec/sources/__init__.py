"""Readers (S1-S11) and writers (K1-K7)."""
