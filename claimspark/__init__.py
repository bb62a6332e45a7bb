"""claimspark: claim auditing as Spark DataFrame plans."""
