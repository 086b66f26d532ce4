"""Triage of large report collections as Spark DataFrame operators.

Task functions are pickled by reference, so that what a Python worker loads once serves all its tasks: on a cluster,
executors need this package on their path (installed, or shipped with ``--py-files``).
"""
