"""PySpark-native engine that reconciles noisy financial statement facts at scale."""
