"""leadlake: data quality, entity resolution and reports over business-contact tables, on Spark."""
