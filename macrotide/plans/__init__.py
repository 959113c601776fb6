"""Chains, pipelines and the registered queries."""
