"""skyfold: geolocation, telemetry and corpus analytics on Spark DataFrames."""
