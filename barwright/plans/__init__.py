"""Feature bundles, pipelines, reports and training."""
