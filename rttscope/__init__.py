"""rttscope: periodic-ping analytics as Spark DataFrame, ML and streaming jobs."""
