"""Scalar functions and conversions, as (binder, bound arguments) -> bound expression."""
