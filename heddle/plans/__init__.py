"""Query modules: each has ``QUERIES`` (name -> callable of session and folder) and ``SQL`` (name -> oracle)."""
