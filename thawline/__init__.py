"""thawline: cold-start interaction analytics as Spark DataFrame operators.

Every operator is a plain function ``DataFrame -> DataFrame`` (usable with
``df.transform``) built from Spark SQL expressions, windows, joins and
aggregates. Drivers loops exist only where the algorithm is iterative
(conjugate gradient, gradient descent, the selection fold) and each step
cuts lineage with a reliable checkpoint in ``spark.checkpoint.dir``.
"""

__version__ = "0.1.0"
