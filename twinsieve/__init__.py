"""twinsieve: choose small, representative subsets of paired data with Spark."""
