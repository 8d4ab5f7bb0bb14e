"""Operators on long tables keyed by pair, fold or scenario and row position."""
