"""Interface-quality analytics over corpora of pages, sources and captures, on Spark."""
