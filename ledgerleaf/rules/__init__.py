"""Rule data. Patterns are written in Python ``re`` syntax with Unicode classes and are
spelled for the JVM (or for RE2, in the check SQL) by ``functions.patterns``."""
