"""Session settings that suit this workload; pass them to the builder's `config(map=...)`."""

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A page may be half a megabyte: keep a batch on its way to Python near 100 MB.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    # Parsing is much slower than reading, so smaller splits keep tasks short.
    "spark.sql.files.maxPartitionBytes": str(32 << 20),
    # Checkpoints that are no longer referenced are removed.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}
