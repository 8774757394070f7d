"""ablaspark: component-ablation analytics for tabular ML, written as Spark jobs."""

__version__ = "0.1.0"
