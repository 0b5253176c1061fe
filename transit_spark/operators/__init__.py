"""Jobs: functions from DataFrames to DataFrames."""
