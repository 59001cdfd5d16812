"""Job-postings data engine on Spark: every operator is a DataFrame job."""
