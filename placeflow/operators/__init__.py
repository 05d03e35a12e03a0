"""Set-based operators, each from data frames to a data frame."""
