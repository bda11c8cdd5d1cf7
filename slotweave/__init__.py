"""Dialogue-corpus construction and retrieval evaluation as Spark DataFrame jobs.

Sub-packages
    functions   Column -> Column building blocks (text, annotations, vectors)
    sources     readers and writers, explicit row ordinals
    operators   DataFrame -> DataFrame operators
    plans       end-to-end jobs and the query catalogue
    streaming   the row-wise part of the corpus job over newly arriving files
"""

__version__ = "0.1.0"
