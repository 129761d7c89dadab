"""Scorers: functions ``(frame with text) -> frame with a score``. Any such function can stand in for another."""
