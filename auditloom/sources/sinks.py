"""Sinks: JSON lines, split folders, indexes as tables, small report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def split_folders(df: DataFrame, path: str) -> None:
    """One Parquet folder per split, as partitions of one table."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def index_tables(postings: DataFrame, stats: DataFrame, path: str) -> None:
    """A lexical index: postings in the order of their tokens, so that readers skip files by token; and its statistics."""
    postings.repartitionByRange("token").sortWithinPartitions("token").write.mode("overwrite").parquet(f"{path}/postings")
    stats.write.mode("overwrite").parquet(f"{path}/stats")


def constant_records(notes: DataFrame, codes: list[str]) -> DataFrame:
    """Prediction records of a constant predictor over the notes of another run."""
    return notes.withColumn("predicted_codes", F.array(*map(F.lit, codes))).withColumn("status", F.lit("success"))


def report_table(df: DataFrame, style: str = "markdown", most: int = 1000) -> str:
    """A small result as Markdown, LaTeX or CSV text; null is a dash. More than ``most`` rows are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report table has at most {most} rows")
    cells = [["—" if v is None else str(v) for v in r] for r in rows]
    if style == "csv":
        return "\n".join(",".join(f'"{c}"' if "," in c else c for c in r) for r in [df.columns, *cells])
    if style == "latex":
        line = lambda r: " & ".join(r) + r" \\"
        return "\n".join([rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", line(df.columns), r"\hline", *map(line, cells), r"\end{tabular}"])
    return "\n".join("| " + " | ".join(r) + " |" for r in [df.columns, ["---"] * len(df.columns), *cells])
