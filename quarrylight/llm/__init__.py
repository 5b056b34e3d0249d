"""Training-data operators: scoring, filtering, deduplication, mixing, sharding and packing.

Every operator is a ``DataFrame -> DataFrame`` function in a module of its own;
``queries`` holds the thin queries that apply them to whole tables.
"""
