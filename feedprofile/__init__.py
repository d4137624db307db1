"""Author-profile analytics on Spark: feeds, traits, text features, reports and evaluation."""
