"""quirelake: a Spark-native engine for bibliographic catalogues.

The catalogue engine lives in ``sources``, ``functions``, ``plans``, ``operators`` and ``streaming``.
``quirelake.llm`` holds the training-data operators and is imported by nothing else in the package.
"""
