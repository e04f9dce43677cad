"""Join strategies, distributed quantiles and multi-step jobs."""
