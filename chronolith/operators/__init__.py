"""Time travel, temporal aggregation and the timeline of a period."""
