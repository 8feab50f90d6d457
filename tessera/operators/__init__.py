"""Kernels, analysis and verifiers over ``tessera.plans.graph.Graph``."""
