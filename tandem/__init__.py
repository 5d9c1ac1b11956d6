"""Paired-prediction analytics on Spark: when may a costly predictor replace a cheap one?"""
