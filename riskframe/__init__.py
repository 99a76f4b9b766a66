"""riskframe: survey and behavioural risk analytics as Spark DataFrame jobs.

Every operator is a pure ``DataFrame -> DataFrame`` (or ``DataFrame -> metric
DataFrame``) transform built from ``pyspark.sql.functions`` so that Catalyst
plans it and whole-stage codegen runs it.  Sub-packages:

* ``functions``  column-expression helpers (null rules, maps, buckets, noise)
* ``sources``    readers, sinks and the fixture bindings over the test tables
* ``operators``  schema, aggregate, window, label, feature, split, metric,
                 scoring, text and ML operators
* ``plans``      end-to-end pipelines and the query registry
* ``streaming``  Structured Streaming variant of the timeline features
"""

__version__ = "0.1.0"
