"""DataFrame-to-DataFrame operators: counting, windows, detectors, severity, incidents, redaction."""
