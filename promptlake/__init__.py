"""promptlake: prompt-economics analytics and text processing as Spark jobs."""
