"""studyloom: a PySpark-native engine for learning content, question banks and assessments."""
