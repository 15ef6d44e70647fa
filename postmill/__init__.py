"""postmill: collection, clean-up and reporting of job postings as Spark DataFrame operators."""
