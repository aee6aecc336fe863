"""Summary tables as DataFrames, files and text."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import half_even, plus_minus, sample_std, whole_std
from ..params import Params
from ..storage import numbered as number_rows
from .analysis import COUNTED, SCORES

#: Titles of the null models' tables, and the prefixes of their columns.
MODELS = {"energy_shuffle": "energy", "topo_shuffle": "topo", "nt_shuffle": "nt", "random_basins": "control"}


def parameter_lines(p: Params) -> list[str]:
    """One line for each parameter."""
    return [f"{k} = {v}" for k, v in asdict(p).items()]


def statistics_lines(found: dict[str, DataFrame]) -> list[str]:
    """One line for each count over all sequences: of the tables' rows, and of runs that failed."""
    names = ("nodes", "edges", "components", "runs", "summary", "failures")
    return [f"{k}: {found[k].count()}" for k in names if k in found]


def numbered(summary: DataFrame) -> DataFrame:
    """Adds number, from 1 by length and seq_id."""
    return number_rows(summary, "number", ["length", "seq_id"]).withColumn("number", F.col("number") + 1)


def _mean(c: str) -> Column:
    return F.avg(f"mean_{c}").alias(f"mean_{c}")


def _std(c: str) -> Column:
    return sample_std(F.col(f"mean_{c}")).alias(f"std_{c}")


def ensemble(summary: DataFrame, null: DataFrame | None = None) -> DataFrame:
    """One row over all sequences: means of the sequences' means, their spread (0 for a single one), counts and their spread as whole numbers."""
    counts = [c for v in COUNTED.values() for c in (half_even(F.avg(v)).alias(v), whole_std(F.col(v)).alias(f"std_{v}"))]
    base = summary.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("length"), *[f(c) for c in (*SCORES, "f_inter") for f in (_mean, _std)], *counts)
    if null is None:
        return base
    other = null.agg(*[f(c) for c in SCORES for f in (_mean, _std)], F.avg("p_value").alias("p_value"))
    return base.crossJoin(other.toDF(*[f"null_{c}" for c in other.columns]))  # one row each


def _score(c: str, before: str = "") -> Column:
    return plus_minus(F.col(f"{before}mean_{c}"), F.col(f"{before}std_{c}"), 4 if c == "f_inter" else 2).alias(before + c)


def _count(c: str) -> Column:
    return F.concat(F.col(c).cast("string"), F.lit("+/-"), F.coalesce(F.col(f"std_{c}"), F.lit(0)).cast("string")).alias(c)


def main_table(summary: DataFrame, average: bool = False) -> DataFrame:
    """number, description (28 characters), length, structures, basins, f_inter with four digits, scores with two; each 'mean+/-std'.

    average: and a row over all sequences, in the same aggregation by grouping sets: its means are of the sequences' means, its spreads theirs.
    """
    rows = numbered(summary)
    if average:
        total = F.grouping_id() > 0
        counts = [c for v in COUNTED.values() for c in (half_even(F.avg(v)).alias(v), F.when(total, whole_std(F.col(v))).otherwise(F.max(f"std_{v}")).alias(f"std_{v}"))]
        scores = [c for v in (*SCORES, "f_inter") for c in (_mean(v), F.when(total, sample_std(F.col(f"mean_{v}"))).otherwise(F.max(f"std_{v}")).alias(f"std_{v}"))]
        of_one = [F.col("number"), F.col("description")]
        both = rows.groupingSets([of_one, []], *of_one).agg(total.alias("_total"), F.count(F.lit(1)).alias("_n"), F.round(F.avg("length")).cast("int").alias("length"), *counts, *scores)
        rows = both.where("_n > 0").withColumn("description", F.when(F.col("_total"), "average").otherwise(F.col("description")))
    return rows.select("number", F.substring("description", 1, 28).alias("description"), "length", _count("n_structures"), _count("n_basins"), _score("f_inter"), *map(_score, SCORES))


def null_table(summary: DataFrame, null: DataFrame) -> DataFrame:
    """number, description, length, the real u_nt, the null model's scores and its p-value with four digits; N/A where there is no sample."""
    other = null.select("seq_id", *[F.col(f"{k}_{c}").alias(f"null_{k}_{c}") for c in SCORES for k in ("mean", "std")], "p_value")
    joined = numbered(summary).join(other, "seq_id", "left")
    p = F.when(F.col("p_value").isNull(), "N/A").otherwise(F.format_string("%.4f", "p_value")).alias("p_value")
    return joined.select("number", F.substring("description", 1, 28).alias("description"), "length", _score("u_nt").alias("real_u_nt"), *[_score(c, "null_") for c in SCORES], p)


def null_average(null: DataFrame) -> DataFrame:
    """The row over all sequences in the columns of `null_table`."""
    row = null.agg(*[f(c) for c in SCORES for f in (_mean, _std)]).select(*[F.col(f"{k}_{c}").alias(f"null_{k}_{c}") for c in SCORES for k in ("mean", "std")])
    empty = F.lit("")
    return row.select(F.lit(None).cast("long").alias("number"), F.lit("average").alias("description"), F.lit(None).cast("int").alias("length"), empty.alias("real_u_nt"), *[_score(c, "null_") for c in SCORES], empty.alias("p_value"))


def report_tables(found: dict[str, DataFrame], p: Params) -> dict[str, DataFrame]:
    """The main table and one for each null model that was run, by title; with the average row where the parameters ask for it."""
    out = {"main": main_table(found["summary"], p.ensemble_row)}
    for model, name in MODELS.items():
        null = found.get(f"null_{model}_summary")
        if null is not None:
            table = null_table(found["summary"], null)
            out[name] = table.unionByName(null_average(null)) if p.ensemble_row else table
    return out


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Writes a table as parquet, csv (with header) or json."""
    df.write.format(kind).mode("overwrite").option("header", "true").save(path)


def text_lines(df: DataFrame, order: str | None = None) -> DataFrame:
    """line of a table as text of fixed widths, and _at, the line's place: the header's -2 and -1, then rows by order (nulls last), from 0.

    The widths are one aggregation; lines are made where the rows are.
    """
    names = df.columns
    shown = {c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in names}
    order = order or ("number" if "number" in names else None)
    key = [F.col(order).isNull().alias("_k0"), F.col(order).alias("_k1")] if order else []
    text = df.select(*key, *[x.alias(f"_{i}") for i, x in enumerate(shown.values())], F.monotonically_increasing_id().alias("_tie"))
    widths = text.agg(*[F.greatest(F.coalesce(F.max(F.length(f"_{i}")), F.lit(0)), F.lit(len(c))).alias(f"w{i}") for i, c in enumerate(names)])
    pad = lambda cells: F.rtrim(F.concat_ws("  ", *[F.rpad(c, F.col(f"w{i}"), F.lit(" ")) for i, c in enumerate(cells)]))
    rows = number_rows(text, "_at", ["_k0", "_k1", "_tie"] if order else [*(f"_{i}" for i in range(len(names))), "_tie"]).join(F.broadcast(widths))  # one row
    head = widths.select(F.lit(-2).cast("long").alias("_at"), pad([F.lit(c) for c in names]).alias("line"))
    rule = widths.select(F.lit(-1).cast("long").alias("_at"), F.concat_ws("  ", *[F.repeat(F.lit("-"), F.col(f"w{i}")) for i in range(len(names))]).alias("line"))
    return head.union(rule).union(rows.select("_at", pad([F.col(f"_{i}") for i in range(len(names))]).alias("line")))


def write_text(df: DataFrame, path: str) -> None:
    """Writes a table as text of fixed widths: files in order, none of which is more than a range of the rows."""
    text_lines(df).repartitionByRange("_at").sortWithinPartitions("_at").select("line").write.mode("overwrite").text(path)


def text_table(df: DataFrame) -> str:
    """A table as text for the console, line by line."""
    return "\n".join(r["line"] for r in text_lines(df).orderBy("_at").select("line").toLocalIterator())


def statistics(summary: DataFrame, nulls: dict[str, DataFrame]) -> DataFrame:
    """number and text of a block for each sequence: means and spreads over its runs, and what each null model gives. nulls: summaries by title."""
    spread = lambda c, digits, unit="": F.concat(plus_minus(F.col(f"mean_{c}"), F.col(f"std_{c}"), digits), F.lit(unit))
    whole = lambda c: F.concat(F.col(c).cast("string"), F.lit("+/-"), F.col(f"std_{c}").cast("string"))
    lines = [F.concat(F.col("description"), F.lit(", "), F.col("length").cast("string"), F.lit(" letters, runs: "), F.col("n_runs").cast("string"))]
    titles = {"u_nt": "nontrivial", "u_tr": "trivial", "u_non": "not ultrametric"}
    lines += [F.concat(F.lit(f"  {title}: "), spread(c, 2, " %")) for c, title in titles.items()]
    lines += [F.concat(F.lit("  triplets between components: "), spread("f_inter", 4))]
    lines += [F.concat(F.lit(f"  {title}: "), whole(c)) for c, title in {"n_structures": "structures", "n_basins": "basins", "n_components": "components"}.items()]
    rows = numbered(summary)
    for title, null in nulls.items():
        cells = [F.concat(F.lit(f"{name} "), plus_minus(F.col(f"mean_{c}"), F.col(f"std_{c}")), F.lit(" %")) for c, name in titles.items()]
        text = F.concat(F.lit(f"  null model {title}, samples: "), F.col("n").cast("string"), F.lit("; "), F.concat_ws(", ", *cells), F.lit("; p = "), F.format_string("%.4f", "p_value"))
        rows = rows.join(null.select("seq_id", text.alias(f"_{title}")), "seq_id", "left")
        lines.append(F.coalesce(F.col(f"_{title}"), F.lit(f"  null model {title}: no sample")))
    return rows.select("number", F.concat_ws("\n", *lines).alias("text"))


def stage_table(spark: SparkSession, found: list[tuple[str, int, float]], samples: int = 1) -> DataFrame:
    """stage, tables, rows, seconds, and seconds for each sample, of what `storage.measured` noted."""
    noted = spark.createDataFrame(found, "stage string, rows long, seconds double")
    total = F.sum("seconds")
    return noted.groupBy("stage").agg(F.count(F.lit(1)).alias("tables"), F.sum("rows").alias("rows"), F.round(total, 3).alias("seconds"), F.round(total / samples, 4).alias("seconds_each"))


class Timer:
    """Seconds by stage of a driver program."""

    def __init__(self):
        self.seconds: dict[str, float] = {}

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began
