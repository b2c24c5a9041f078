"""Dataset presets, the pipeline run, and bindings of the operators to the test tables."""
