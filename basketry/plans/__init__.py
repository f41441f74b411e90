from basketry.plans.jobs import build_splits, ingest, run_baselines

__all__ = ["build_splits", "ingest", "run_baselines"]
