"""Image+text table jobs on Spark: prepare, embed, fuse, parse, evaluate, report."""
