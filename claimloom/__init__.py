"""claimloom: auditing prose at corpus scale, on Spark DataFrames."""
