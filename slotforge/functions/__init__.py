"""Column functions: value normalisers, dates, digests."""
