"""linkengine: record linkage and table analytics as Spark plans."""
