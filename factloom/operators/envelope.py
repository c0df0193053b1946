"""Responses: a page of rows with totals, coverage and the query's echo; errors in the same form.

Totals come from the job that makes the page: an observation on the plan below the top-k counts the rows that go by.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import page_bounds
from ..session import Session


def coverage(wanted: DataFrame, s: Session, named: int = 1000) -> dict[str, Any]:
    """How much of a classpath (filename) is indexed, in one job. At most ``named`` missing files are named, the first
    by name; jars_missing_unnamed is the number of others."""
    seen = Observation()
    known = s["shards"].select("filename", F.lit(1).alias("known")).distinct()
    files = wanted.select("filename").distinct().join(known, "filename", "left").observe(seen, F.count(F.lit(1)).alias("total"), F.count("known").alias("indexed"))
    missing = [r.filename for r in files.where("known is null").orderBy("filename").limit(named).collect()]
    total, indexed = seen.get["total"], seen.get["indexed"]
    return {"jars_total": total, "jars_indexed": indexed, "jars_missing": missing, "jars_missing_unnamed": total - indexed - len(missing)}


def respond(query: dict[str, Any], df: DataFrame, order: list[str], page: int = 1, size: int = 20, exact: bool = True, covered: dict[str, Any] | None = None) -> dict[str, Any]:
    """A page of ``df``, made by one job. An exact total counts all rows as they go by; otherwise the total is the page's. One row more than
    the page is read to tell whether there are more. ``covered`` is what ``coverage`` says of the session."""
    offset, limit = page_bounds(page, size)
    keys = [F.col(c).asc_nulls_first() for c in order]
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("total")) if exact else df
    rows = [r.asDict(recursive=True) for r in counted.orderBy(*keys).offset(offset).limit(limit + 1).collect()]
    out = {"query": query, "page": page, "page_size": size, "has_more": len(rows) > limit, "results": [{k: v for k, v in r.items() if v is not None} for r in rows[:limit]]}
    out["total"] = seen.get["total"] if exact else len(out["results"])
    return out if covered is None else out | {"coverage": covered}


def error_response(e: Exception, code: str | None = None) -> dict[str, str]:
    """(error, message) of a failed query: the code, bad_request for what the caller got wrong and internal otherwise, and the message's first line."""
    code = code or ("bad_request" if isinstance(e, (ValueError, KeyError)) else "internal")
    return {"error": code, "message": (str(e) or type(e).__name__).splitlines()[0]}


def answered(query: dict[str, Any], make, *args, **kwargs) -> dict[str, Any]:
    """``respond`` to what ``make`` returns, or the error of either."""
    try:
        return respond(query, make(), *args, **kwargs)
    except Exception as e:
        return {"query": query} | error_response(e)
