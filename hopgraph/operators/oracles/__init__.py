"""Distance oracles: build once, then answer batches of pairs."""
