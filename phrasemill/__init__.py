"""Spark-native conversion, audit, scoring and curation of question/answer datasets.

Every public function takes and returns DataFrames; nothing is collected and nothing
but the user's own model callable (:func:`phrasemill.operators.annotate.annotate_batches`)
runs outside the JVM.
"""
