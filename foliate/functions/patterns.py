"""Checks of patterns in the dialect that runs them, Java's, and of what would make them slow."""

from __future__ import annotations

import re

#: A repeated group that itself holds an open-ended repetition: matching may take exponential time, and nothing ends it.
_NESTED = re.compile(r"\((?:\?[:>]|\?<\w+>)?[^()]*(?<!\\)[+*][^()]*\)(?:[+*]|\{\d+,\})")


def java_error(pattern: str) -> str | None:
    """What Java's compiler says against a pattern, None if nothing. Asked of the JVM where a session runs; else Python's
    compiler is asked, with group names in Java's form, which takes most of the same patterns."""
    from pyspark import SparkContext

    context = SparkContext._active_spark_context
    if context is not None:
        try:
            context._jvm.java.util.regex.Pattern.compile(pattern)
            return None
        except Exception as e:  # the JVM's own error, wrapped
            said = getattr(e, "java_exception", None)
            return str(said.getDescription()) if said is not None and hasattr(said, "getDescription") else str(e).splitlines()[0]
    if "(?P<" in pattern:
        return "Java names groups (?<name>...)"
    try:
        re.compile(_pythonic(pattern))
    except re.error as e:
        return str(e)
    return None


def _pythonic(pattern: str) -> str:
    return re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", pattern).replace(r"\p{", "[{").replace(r"\P{", "[{")


def java_groups(pattern: str) -> int:
    """The number of capturing groups."""
    from pyspark import SparkContext

    context = SparkContext._active_spark_context
    if context is not None:
        return int(context._jvm.java.util.regex.Pattern.compile(pattern).matcher("").groupCount())
    return re.compile(_pythonic(pattern)).groups


def slow_error(pattern: str) -> str | None:
    """What could make a pattern of a user run for ever: Spark puts no bound on matching time, so a repetition of a repetition is
    refused."""
    return "a repeated group holds an open repetition" if _NESTED.search(pattern) else None
