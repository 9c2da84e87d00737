"""T-SQL semantics on Spark: a front end that lowers T-SQL batches to declarative Spark plans."""

__all__ = ["BINARY", "Result", "TsqlError", "TsqlSession"]


def __getattr__(name: str):
    # loaded on first use, so that tasks which need one module don't load the front end
    if name not in __all__:
        raise AttributeError(name)
    from . import errors, session

    return getattr(errors if name == "TsqlError" else session, name)
