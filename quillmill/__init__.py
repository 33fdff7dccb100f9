"""quillmill: a Spark-native engine for corpus building and stylometry."""
