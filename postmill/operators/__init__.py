"""DataFrame -> DataFrame operators over postings, runs and the watchlist."""
