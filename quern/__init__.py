"""Quern: chat-message analytics and text-corpus operators on Spark DataFrames."""
