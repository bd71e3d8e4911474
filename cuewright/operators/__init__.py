"""DataFrame operators, for use with ``DataFrame.transform`` or directly."""
