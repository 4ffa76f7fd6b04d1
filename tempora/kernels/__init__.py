"""kernels of the time-series engine."""
