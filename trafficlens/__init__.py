"""Web-log traffic analytics, forecasting features and capacity planning on Spark."""
