"""Log distillation on Spark: noisy command output in, compact typed events out."""
