"""Event studies, stress monitoring and corpus analytics as PySpark DataFrame operators."""
