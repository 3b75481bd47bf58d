"""funnelspark: lead-to-enrollment funnel analytics as lazy Spark DataFrame queries.

Sub-packages
------------
functions   column expressions, rule tables, term codes, classification, tuition, scoring
sources     CRM view over the driver tables, payload flatteners, table storage
operators   entities, revenue fact, KPIs, cohorts, pipeline health, journeys,
            uploaded-lead / enrollment / budget reports, QA, privacy, profiling, text jobs
plans       the full CRM DAG and the query registry used by ``__spark_entry__``
streaming   incremental landing of CRM activity payloads with Structured Streaming
"""

__version__ = "0.1.0"
