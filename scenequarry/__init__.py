"""Scene analytics on Spark: tables of scenes, tiles, pixels, questions, predictions and runs."""
