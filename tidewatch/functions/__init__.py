"""Scalar functions as Columns; Arrow functions only where built-ins cannot express the semantics."""
