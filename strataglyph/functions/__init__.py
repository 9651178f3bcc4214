"""Scalar text functions as Column builders."""
