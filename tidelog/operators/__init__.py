"""Operators on event logs; a log has timeline_id, term, off, payload and more.

Every operator is a plan over DataFrames: nothing is collected, and every join has an
equality on the timeline, so that it is a hash or merge join with a residual condition.
"""
