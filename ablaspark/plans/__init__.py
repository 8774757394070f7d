"""Studies made of several operators: ablation runs, refinement, reports."""
