"""denpyo: a Spark engine that reads, checks and reconciles billing documents."""
