"""The query registry: Spark plans beside the SQL that checks them."""
