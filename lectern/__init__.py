"""Scientific-text analytics on Spark: operators are functions DataFrame -> DataFrame."""
