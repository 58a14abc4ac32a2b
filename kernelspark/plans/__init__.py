"""Composed plans: MEKA data set, train + evaluate, registered queries."""
