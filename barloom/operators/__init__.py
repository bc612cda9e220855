"""Operators: functions from DataFrame to DataFrame, chained with df.transform."""
