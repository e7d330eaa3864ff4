"""PySpark-native engine for retrieval-augmented question answering data.

Everything is DataFrame-in, DataFrame-out: sources read passages, questions,
traces and telemetry; operators chunk, embed, index, retrieve, rerank, parse
and regularise; plans hold the registered queries; streaming holds the
micro-batch ingest.  The ``llm`` subpackage is optional.
"""
