"""DataFrame -> DataFrame operators over entries(sensor_id, seq, ts, vec, ...)."""
