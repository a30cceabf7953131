"""tallyfold: behavioural and revenue analytics expressed as Spark DataFrame plans."""
