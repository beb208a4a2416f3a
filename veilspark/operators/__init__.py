"""DataFrame operators: detection, mapping, redaction, audits, review, release, units."""
