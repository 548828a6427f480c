"""regrove: profiling, preparing and modelling wide feature tables on Spark."""
