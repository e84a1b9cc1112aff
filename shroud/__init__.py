"""Detection, redaction and evaluation of personal data on Spark."""
