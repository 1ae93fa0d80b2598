"""A registry of queries: what they return, how Spark makes it, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.plans.lineage import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
DEFINED: dict[str, tuple[Callable, list[list[str]]]] = {}
ORACLES: dict[str, str] = {}
TYPES = {"s": ("string", "VARCHAR"), "i": ("long", "BIGINT"), "d": ("double", "DOUBLE"), "b": ("boolean", "BOOLEAN")}


class Tables:
    """The given tables by name, read lazily. ``corpus``: the column of pages whose bytes are the corpus."""

    def __init__(self, spark: SparkSession, sf_dir: str, corpus: str = "url") -> None:
        self.spark, self.sf_dir, self.corpus = spark, sf_dir, corpus

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


def query(name: str, columns: str, sql: str | None = None) -> Callable:
    """Register a function of Tables. ``columns``: name:type, ...; doubles are rounded to six places on both sides."""
    own = [c.split(":") for c in columns.split()]

    def add(fn: Callable[[Tables], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(Tables(spark, sf_dir))
            return df.select(*(F.round(F.col(c).cast("double"), 6).alias(c) if k == "d" else F.col(c).cast(TYPES[k][0]).alias(c) for c, k in own))

        QUERIES[name], DEFINED[name] = run, (fn, own)
        if sql:
            cols = ", ".join(f'ROUND(CAST("{c}" AS DOUBLE), 6) AS "{c}"' if k == "d" else f'CAST("{c}" AS {TYPES[k][1]}) AS "{c}"' for c, k in own)
            ORACLES[name] = f"SELECT {cols} FROM ({sql}) AS q"
        return fn

    return add


def over_html(name: str, digest: bool = True, checked: bool = True, arrays: Callable[..., dict] | None = None) -> None:
    """Register ``name`` over the bytes of whole pages in place of their addresses, as ``name``_html.

    With ``digest`` the result is, per path, the number of rows and the sum of a hash of each whole row. Not ``checked``: without
    SQL, where it would take hours. ``arrays`` makes the rows of pages from arrays of their bytes (``packed.Contents.digested``) in
    the task that holds them; very long pages and repeated or missing page ids go by tables as without it.
    """
    fn, own = DEFINED[name]
    sql = ORACLES[name].replace("strlen(url)", "strlen(html)").replace("encode(url)", "encode(html)").replace("WHERE url IS NOT NULL", "WHERE html IS NOT NULL")
    if not digest:
        query(f"{name}_html", " ".join(":".join(c) for c in own), sql)(lambda t: fn(Tables(t.spark, t.sf_dir, "html")))
        return
    text = ", ".join(f"""coalesce(CAST({f'CAST(round("{c}" * 1000) AS BIGINT)' if k == "d" else f'"{c}"'} AS VARCHAR), '~')""" for c, k in own)
    shown = f"SELECT path, count(*) AS rows, sum(('0x' || substring(md5(concat_ws('|', {text})), 1, 8))::BIGINT) AS digest FROM ({sql}) GROUP BY path"

    def by_rows(t: Tables) -> DataFrame:
        rows = fn(t).select(*((F.round(F.round(F.col(c).cast("double"), 6) * 1000).cast("long") if k == "d" else F.col(c).cast(TYPES[k][0])).cast("string").alias(c) for c, k in own))
        code = F.conv(F.substring(F.md5(F.concat_ws("|", *(F.coalesce(F.col(c), F.lit("~")) for c, _ in own))), 1, 8), 16, 10).cast("long")
        return rows.groupBy("path").agg(F.count("*").alias("rows"), F.sum(code).alias("digest"))

    def whole(t: Tables) -> DataFrame:
        html = Tables(t.spark, t.sf_dir, "html")
        if arrays is None:
            return by_rows(html)
        from seqloom.plans.derived import url_contents

        contents, rest = url_contents(html, arrays)
        out, pages = contents.digested([c for c, _ in own]), html.pages.select("page_id", "html")
        unnamed = pages.where("page_id is null and html is not null")
        odd = None if unnamed.isEmpty() else unnamed
        if rest is not None:
            twice = rest.select(F.col("path").alias("page_id"), F.decode("content", "UTF-8").alias("html"))
            odd = twice if odd is None else twice.union(odd)
        if odd is None:
            return out
        html.pages = odd
        return out.unionByName(by_rows(html))

    query(f"{name}_html", "path:s rows:i digest:i", shown if checked else None)(whole)
