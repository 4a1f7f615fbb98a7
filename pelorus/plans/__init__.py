"""Configurations, pipelines and experiments made of the operators."""
