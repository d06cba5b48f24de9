"""Credit-risk operators on Spark: payment histories, features, calibration, audit."""
