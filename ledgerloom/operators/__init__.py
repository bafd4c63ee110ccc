"""DataFrame operators: profiling, role detection, matching, comparison, stored results."""
