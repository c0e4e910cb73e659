"""evalsweep: model-evaluation sweeps as Spark tables.

Grid expansion, prompt building, batch inference, scoring, roll-ups, telemetry,
rule checks and result storage, all as DataFrame transformations.  See the
README for the table layouts and for how each step behaves at scale.
"""
