"""Building blocks of the reports and operators on their results."""
