"""corpusmill: PySpark-native operators that turn raw text corpora into training rows."""
