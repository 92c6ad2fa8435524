"""Finding and tracking abusive clients in server logs, as Spark DataFrame operators."""
