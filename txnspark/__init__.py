"""Spark-native analytics for card transactions.

Features, encoders, scoring, review policy, queues and evaluation, each as a
function from DataFrame to DataFrame.
"""
