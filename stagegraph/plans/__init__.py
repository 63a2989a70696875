"""Stages and lanes: lazy plans over keyed DataFrames."""
