"""Training-data operators: one module an operator, queries in ``queries``.

Nothing outside this package imports it; it imports only PySpark, numpy,
pyarrow and the tokenizer files whose path is a parameter.
"""
