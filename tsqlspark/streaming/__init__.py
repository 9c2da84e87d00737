"""Streams as tables: the dialect has no streaming statements of its own, but a query over a stream is a stream.

``TsqlSession.register`` takes a streaming frame like any other; a SELECT over it that needs no second look at its rows
(no TOP, PERCENT or assignment) gives a streaming frame for ``writeStream``.
"""
