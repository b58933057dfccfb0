"""Functions from columns to columns, all built of Spark's own expressions."""
