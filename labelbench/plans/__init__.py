"""End-to-end plans: dataset preparation, one experiment, the experiment suite, artifact summary."""
