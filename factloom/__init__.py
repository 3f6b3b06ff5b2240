"""factloom: evidence resolution over recognised label text, expressed as Spark DataFrame plans."""
