"""Column functions: binning, entropy, weights, colours, tails."""
