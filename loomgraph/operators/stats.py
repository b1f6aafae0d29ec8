"""Usage, token and progress statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def class_usage(mentions: DataFrame) -> DataFrame:
    return mentions.where("type_label is not null").groupBy(F.coalesce(F.nullif("type_uri", F.lit("")), "type_label").alias("class")).agg(F.count("*").alias("n"))


def predicate_usage(triples: DataFrame) -> DataFrame:
    uri = F.nullif("predicate_uri", F.lit("")) if "predicate_uri" in triples.columns else F.lit(None).cast("string")
    return triples.groupBy(F.coalesce(uri, "predicate_sf").alias("predicate")).agg(F.count("*").alias("n"))


def usage(calls: DataFrame) -> DataFrame:
    """(step, prompt_tokens, completion_tokens, total_tokens, execution_time) by step, and overall with step null; reported names vary."""
    have = set(calls.columns)
    pick = lambda *names: F.coalesce(*[F.col(n) for n in names if n in have], F.lit(0)).cast("long")
    p, c = pick("prompt_tokens", "input_tokens"), pick("completion_tokens", "output_tokens")
    total = F.coalesce(F.col("total_tokens").cast("long"), p + c) if "total_tokens" in have else p + c
    seconds = F.col("execution_time") if "execution_time" in have else F.lit(0.0)
    rows = calls.select("step", p.alias("p"), c.alias("c"), total.alias("t"), seconds.alias("s"))
    return rows.rollup("step").agg(F.sum("p").alias("prompt_tokens"), F.sum("c").alias("completion_tokens"), F.sum("t").alias("total_tokens"), F.sum("s").alias("execution_time"))


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(100.0 * done / total, 1)).otherwise(0.0)


def eta(done: Column, total: Column, elapsed: Column) -> Column:
    """Seconds left at the present rate; null before the first is done."""
    return F.when((done > 0) & (elapsed > 0), F.greatest(total - done, F.lit(0)) / (done / elapsed))


def reports(done: Column, total: Column, share: int = 5) -> Column:
    """Whether a count of finished documents, failed ones too, is worth a line: the first to pass each ``share`` per cent, and the last."""
    step = lambda n: F.floor(n * 100 / (total * share))
    return (total > 0) & ((done == total) | (step(done) > step(done - 1)))


def headers(stats: DataFrame, most: int = 1024) -> DataFrame:
    """(name, value) that fit a header: Latin-1 and not too long."""
    return stats.where(~F.col("value").rlike(r"[^\x00-\xFF]") & (F.length("value") <= most))


class AllFailed(RuntimeError):
    """Every document failed."""


def failures(results: DataFrame) -> DataFrame:
    """(id, error) of the documents that failed; raises only if all did."""
    n = results.agg(F.count("*").alias("n"), F.count("error").alias("bad")).first()
    if n.n and n.n == n.bad:
        first = ", ".join(f"{r.id}: {r.error}" for r in results.orderBy("id").limit(20).collect())
        raise AllFailed(f"all {n.n} documents failed ({first})")
    return results.where("error is not null").select("id", "error")
