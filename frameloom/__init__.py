"""Frameloom: clip, keyframe and job-state analytics on Spark DataFrames."""
