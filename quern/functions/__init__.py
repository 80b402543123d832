"""Column functions that Spark lacks, composed of those it has."""
