"""Query builders used by the driver contract: name -> DataFrame, name -> oracle SQL."""
