"""Lenient JSON (M09, M10): the first object in a reply, repaired if need be. One Arrow UDF; rows fail alone."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Strings stay as they are; comments and commas before a closing bracket go.
_PARTS = re.compile(r"""("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|//[^\n]*|/\*.*?\*/|,(?=\s*[}\]])""", re.S)
_QUOTED_OR_BRACE = re.compile(r'"(?:\\.|[^"\\])*"?|[{}]', re.S)


def first_object(text: str) -> str:
    """From the first brace to the one that closes it, or to the end; ValueError without a brace."""
    start = text.index("{")
    depth = 0
    for m in _QUOTED_OR_BRACE.finditer(text, start):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if not depth:
            return text[start : m.end()]
    return text[start:]


def parse(text: str, strict: bool = False) -> dict:
    piece = first_object(re.sub(r"\A\s*```(?:json)?\s*|\s*```\s*\Z", "", text))
    attempts = [lambda: json.loads(piece)]
    if not strict:
        mended = _PARTS.sub(lambda m: m[1] or "", piece)
        mended = _PARTS.sub(lambda m: m[1] or "", mended)
        attempts += [lambda: json.loads(mended), lambda: ast.literal_eval(mended)]
    for attempt in attempts:
        try:
            value = attempt()
        except (ValueError, SyntaxError, RecursionError, MemoryError, TypeError):
            continue
        if isinstance(value, dict):
            return value
    raise ValueError(f"no JSON object: {piece[:60]}")


def _parsed(strict: bool):
    @F.pandas_udf(StructType([StructField("status", StringType()), StructField("value", StringType())]))
    def run(reply: pd.Series) -> pd.DataFrame:
        out = []
        for r in reply:
            try:
                out.append(("ok", json.dumps(parse(r or "", strict), sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=str)))
            except ValueError as e:
                out.append(("error", str(e)))
        return pd.DataFrame(out, columns=["status", "value"])

    return run


def lenient(reply: Column) -> Column:
    """Ok and the object as canonical JSON, or error and its reason."""
    return _parsed(False)(reply)


def strict(reply: Column) -> Column:
    """The same without repairs: the object must be JSON as it stands."""
    return _parsed(True)(reply)
