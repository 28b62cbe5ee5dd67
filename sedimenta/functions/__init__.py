"""Part of the evidence-to-graph analytics."""
