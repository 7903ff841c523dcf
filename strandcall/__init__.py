"""Labelled gene-perturbation datasets on Spark: build, curate, sample, evaluate."""
