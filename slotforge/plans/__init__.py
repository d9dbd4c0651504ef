"""Whole jobs: evidence to routed slots, decisions to deliverables."""
