"""Inspectors for tests of the seam."""

from collections import deque

from pyspark.sql import functions as F

from tidewarden.operators import inspectors


class Burst(inspectors.Lookback):
    """A write is odd if two of its key's last three asked-for writes came within five seconds and had its number of words."""

    flag, window = "burst_suspected", 3

    def columns(self):
        return {"n": F.size(F.split("content", " ")), "kind": F.col("source_class")}

    def takes(self):
        return F.col("source_class") != "user_input"

    def start(self):
        return deque(maxlen=3)

    def see(self, memory, row):
        hit = sum(row["secs"] - p["secs"] <= 5 and p["n"] == row["n"] for p in memory) >= 2
        memory.append(row)
        return hit


class Never(inspectors.Lookback):
    flag, window = "never", 0

    def columns(self):
        return {}

    def start(self):
        return None

    def see(self, memory, row):
        return False
