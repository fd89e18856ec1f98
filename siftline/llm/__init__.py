"""Training-data operators: language, quality, dedup, decontamination, toxicity, token output.

Each module holds one operator with its own interface; ``queries`` registers one query per operator.
Nothing outside this folder imports it.
"""
