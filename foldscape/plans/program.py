"""From a folder of FASTA files to tables and text: python -m foldscape.plans.program FOLDER [--out FOLDER] [name=value ...]"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession

from ..params import Params
from ..session import build
from ..sources.fasta import literal_sequence, load_folder
from ..storage import measured, scratch
from .analysis import analyze
from .report import MODELS, Timer, parameter_lines, report_tables, stage_table, statistics, statistics_lines, text_table, write_table, write_text

#: Null models that are slow with more samples than this.
MANY_SAMPLES = {"energy_shuffle": 30, "topo_shuffle": 20, "full_analysis": 20, "nt_shuffle": 10}


def parameters(texts: Sequence[str]) -> Params:
    """Parameters from name=value texts; others have their defaults."""
    kinds = {f.name: type(f.default) for f in fields(Params)}
    given = {}
    for t in texts:
        name, _, value = t.partition("=")
        if name not in kinds:
            raise ValueError(f"no parameter {name}")
        given[name] = value.lower() in ("1", "true", "yes") if kinds[name] is bool else kinds[name](value)
    return Params(**given)


def run(spark: SparkSession, source: str, p: Params = Params(), out: str | None = None, literal: bool = False) -> str:
    """Analyses a folder's sequences, or one sequence itself, writes the tables to out, if given, and returns the report's text.

    Sequences and files that are left out, and runs that fail, are listed with their reasons. The folders that the work
    needed in the shared folder are gone at the end.
    """
    timer, lines = Timer(), ["parameters", *parameter_lines(p)]
    if MANY_SAMPLES.get(p.null_model, p.num_null) < p.num_null:
        lines.append(f"note: {p.num_null} samples of {p.null_model} take long; {MANY_SAMPLES[p.null_model]} or fewer are usual")
    with scratch(spark):
        with timer.stage("read"):
            sequences, left_out = (literal_sequence(spark, source), None) if literal else load_folder(spark, source)
        with timer.stage("analysis"):
            with measured() as noted:
                found = analyze(sequences, p)
        with timer.stage("report"):
            lines += ["", "statistics", *statistics_lines(found)]
            for title, df in ([] if left_out is None else [("left out", left_out)]) + [("failures", found["failures"])]:
                if not df.isEmpty():
                    lines += ["", title, text_table(df)]
            nulls = {title: found[f"null_{model}_summary"] for model, title in MODELS.items() if f"null_{model}_summary" in found}
            blocks = statistics(found["summary"], nulls)
            lines += [r["text"] for r in blocks.orderBy("number").toLocalIterator()]
            tables = report_tables(found, p)
            for title, df in tables.items():
                lines += ["", title, text_table(df)]
            lines += ["", "stages", text_table(stage_table(spark, noted.found, p.num_null if nulls else 1))]
        if out:
            with timer.stage("write"):
                _write(found, out)
                for title, df in tables.items():
                    write_text(df, f"{out}/text/{title}")
                blocks.select("text").write.mode("overwrite").text(f"{out}/text/statistics")
    lines += ["", "seconds", *(f"{k}: {v:.1f}" for k, v in timer.seconds.items())]
    return "\n".join(lines)


def _write(found: dict[str, DataFrame], out: str) -> None:
    for name, df in found.items():
        write_table(df, f"{out}/{name}")


def main(args: Sequence[str]) -> int:
    if not args:
        print(__doc__)
        return 2
    folder, rest = args[0], list(args[1:])
    out = None
    if rest[:1] == ["--out"]:
        out, rest = rest[1], rest[2:]
    print(run(build(), folder, parameters(rest), out))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
