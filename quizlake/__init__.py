"""quizlake — learning analytics over an answer log, written for PySpark.

Every operator takes and returns DataFrames; nothing is collected to the
driver except bounded, already-aggregated results that a caller asks for.
"""

__version__ = "0.1.0"
