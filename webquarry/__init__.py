"""webquarry: web-page analytics and training-data operators on Spark."""
