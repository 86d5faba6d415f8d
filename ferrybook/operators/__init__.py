"""The report operators: flows in, a small report-ready DataFrame out."""
