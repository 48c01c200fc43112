"""DataFrame-to-DataFrame operators for gridded, census and observation data."""
