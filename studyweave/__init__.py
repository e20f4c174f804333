"""Cohort integration over long clinical records, written as Spark DataFrame steps."""
