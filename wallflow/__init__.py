"""Network-flow and firewall-rule analytics on Spark DataFrames."""
